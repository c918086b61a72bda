"""Connected components of equal-valued cells, and the minimum mapping unit.

Cells are dealt out in square blocks.  Inside a block runs of equal cells are
joined by union-find; the labels of touching blocks then form a graph, much
smaller than the lattice, whose components name the components of the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecotone.operators.graph import components as graph_components
from ecotone.sources.staging import stage

#: The mapping unit in square metres, and the most cells of a component that are counted.
MMU_AREA = 5000.0
MAX_SIZE = 500
LEGACY_MAX_SIZE = 512


def _label(pdf, band: str, width: int):
    """Rows of one block with `local`: the smallest cell id of the block's component."""
    import numpy as np

    r, c, v = (pdf[n].to_numpy() for n in ("row_idx", "col_idx", band))
    r0, c0 = r.min(), c.min()
    grid = np.full((r.max() - r0 + 1, c.max() - c0 + 3), -1, dtype=np.int64)
    grid[r - r0, c - c0 + 1] = v
    parent: list = []

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    runs = np.full(grid.shape, -1, dtype=np.int64)
    first: list = []
    above: list = []
    for i, line in enumerate(grid):
        cuts = np.flatnonzero(np.diff(line)) + 1
        here = []
        for a, b in zip(cuts, [*cuts[1:], len(line)], strict=False):
            if line[a] < 0:
                continue
            k = len(parent)
            parent.append(k)
            first.append((i + r0) * width + (a - 1 + c0))
            runs[i, a:b] = k
            here.append((a, b, line[a], k))
        j = 0
        for a, b, value, k in here:  # eight neighbours: runs whose columns touch, also across a corner
            while j < len(above) and above[j][1] < a:
                j += 1
            for p, q, other, m in above[j:]:
                if p > b:
                    break
                if q >= a and other == value:
                    x, y = top(k), top(m)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        above = here
    root = np.array([first[top(k)] for k in range(len(parent))] or [0], dtype=np.int64)
    return pdf.assign(local=root[runs[r - r0, c - c0 + 1]])


def label(df: DataFrame, band: str, width: int, block: int = 512, keys: list[str] | None = None) -> DataFrame:
    """df's cells whose band is not null, with `component`: the smallest row_idx * width + col_idx of their eight-connected equals.

    `width` exceeds every column number.  With keys (a mountain, a band's name)
    components are apart for each key.
    """
    keys = keys or []
    cells = df.where(F.col(band).isNotNull()).withColumns({"_br": F.floor(F.col("row_idx") / block), "_bc": F.floor(F.col("col_idx") / block)})
    cells = cells.withColumn(band, F.col(band).cast("int"))
    schema = f"{cells.schema.simpleString()[7:-1]}, local: bigint"

    def run(pdf):
        return _label(pdf, band, width)

    local = stage(cells.groupBy(*keys, "_br", "_bc").applyInPandas(run, schema), "cells")
    # cells on a block's rim meet those of the blocks right, below and at the lower corners
    rim = (F.col("row_idx") % block == 0) | (F.col("row_idx") % block == block - 1) | (F.col("col_idx") % block == 0) | (F.col("col_idx") % block == block - 1)
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.col("local").cast("string")) if keys else F.col("local")
    edge = local.where(rim).select(*keys, "row_idx", "col_idx", "_br", "_bc", band, key.alias("node"))
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = edge.select(*keys, F.inline(steps), "row_idx", "col_idx", F.col("_br").alias("br"), F.col("_bc").alias("bc"), F.col(band).alias("value"), F.col("node").alias("u"))
    near = near.select(*keys, (F.col("row_idx") + F.col("dr")).alias("row_idx"), (F.col("col_idx") + F.col("dc")).alias("col_idx"), "br", "bc", "value", "u")
    pairs = near.join(edge, [*keys, "row_idx", "col_idx"]).where((F.col("value") == F.col(band)) & ((F.col("br") != F.col("_br")) | (F.col("bc") != F.col("_bc")))).select("u", F.col("node").alias("v")).distinct()
    named = graph_components(pairs).withColumnsRenamed({"id": "node", "component": "whole"})
    joined = local.withColumn("node", key).join(named, "node", "left")
    whole = F.coalesce(F.col("whole"), F.col("node"))
    return joined.withColumn("component", whole).drop("node", "whole", "local", "_br", "_bc")


def sizes(labelled: DataFrame, area: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """labelled with `n`, its component's cells, and `component_area`, their summed area."""
    keys = keys or []
    per = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"), F.sum(area if area is not None else F.lit(1.0)).alias("component_area"))
    return labelled.join(per, [*keys, "component"])


def mmu_sequence(df: DataFrame, band: str, area: Column, width: int, most: int = MAX_SIZE, unit: float = MMU_AREA, block: int = 512) -> DataFrame:
    """df with `clean`: small components of either class become forest, then forest components under the unit go.

    A component's area is its capped cell count times the cell's own area, so
    cells of one component may be judged apart; the first rule is at most the
    unit, the second at least.  Cells that were masked stay masked.
    """
    first = sizes(label(df.select("row_idx", "col_idx", band), band, width, block)).withColumn("_small", (F.least("n", F.lit(most)) * area <= unit).cast("int"))
    filled = first.select("row_idx", "col_idx", F.when((F.col(band) + F.col("_small")) >= 1, 1).alias("_filled"))
    second = sizes(label(filled, "_filled", width, block)).where(F.least("n", F.lit(most)) * area >= unit).select("row_idx", "col_idx", F.lit(1).alias("_keep"))
    return df.join(second, ["row_idx", "col_idx"], "left").withColumn("clean", F.when(F.col(band).isNotNull(), F.coalesce("_keep", F.lit(0)))).drop("_keep")


def mmu_legacy(df: DataFrame, band: str, area: Column, width: int, unit: float = MMU_AREA, block: int = 512) -> DataFrame:
    """df with `clean`: forest components of at most the unit go, then gaps under it are filled; areas are summed cell areas, masked cells count as no forest."""
    raw = df.select("row_idx", "col_idx", F.coalesce(F.col(band), F.lit(0)).alias("_raw"))
    small = sizes(label(raw.withColumn("_f", F.when(F.col("_raw") == 1, 1)), "_f", width, block), area).where(F.col("component_area") <= unit).select("row_idx", "col_idx", F.lit(1).alias("_gone"))
    kept = raw.join(small, ["row_idx", "col_idx"], "left").withColumn("_kept", ((F.col("_raw") == 1) & F.col("_gone").isNull()).cast("int"))
    gaps = sizes(label(kept.select("row_idx", "col_idx", F.when(F.col("_kept") == 0, 1).alias("_g")), "_g", width, block), area).where(F.col("component_area") < unit).select("row_idx", "col_idx", F.lit(1).alias("_fill"))
    clean = kept.join(gaps, ["row_idx", "col_idx"], "left").select("row_idx", "col_idx", F.when((F.col("_kept") == 1) | F.col("_fill").isNotNull(), 1).otherwise(0).alias("clean"))
    return df.join(clean, ["row_idx", "col_idx"])
