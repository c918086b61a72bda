"""All mountains' products in one plan: nothing is collected, no loop over mountains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.functions import masks
from ecotone.functions.tests import upper, welch
from ecotone.operators import products, regrid, stencil, thresholds

#: Cells to each side of the 150 m window: 150 m over 27.83 m, rounded down.
WINDOW = 5


def mountain_bundle(cells: DataFrame, climate: DataFrame, least: int = 5, rise: float = 0.0, samples: float = thresholds.MIN_SAMPLES, k: int = WINDOW) -> dict[str, DataFrame]:
    """treeline30m, treeline1km, qa30m and the thresholds of every mountain.

    cells: a dense lattice with row_idx, col_idx, mountain_id (null outside all),
    tree_<year>_<label> (0, 1, null), elevation (integer), landform, dem_msk,
    dem_stk, hm_fraction, tree_fraction.  climate: crow, ccol, bio01_raw.

    Edges are found before any mask; a threshold comes from the climate cells
    that either year's candidates touch, each cell once; both samples of the
    test lie inside the mountain; a mountain without a valid threshold has no
    treeline.  Thresholds, a row for each mountain and label, join back as a
    table.
    """
    kinds = [(y, x) for x in products.LABELS for y in products.EPOCHS]
    name = lambda y, x: f"tree_{y}_{x}"
    edge = lambda y, x: f"_edge_{y}_{x}"
    df = cells.withColumns({edge(y, x): F.col(name(y, x)).cast("double") for y, x in kinds})
    df = stencil.forest_edges(df, [edge(y, x) for y, x in kinds])
    inside = F.col("mountain_id").isNotNull()
    df = df.withColumn("non_valley", masks.invert(masks.class_mask(F.col("landform"), products.VALLEY_CLASSES)))
    df = df.withColumns({f"candidate_edge_{y}_{x}": F.when(inside & (F.col(edge(y, x)) == 1), 1) for y, x in kinds})
    df = df.withColumns({f"edge_post_landform_{y}_{x}": F.when((F.col(f"candidate_edge_{y}_{x}") == 1) & (F.col("non_valley") == 1), 1) for y, x in kinds})
    # both labels' candidates meet the climate cells in one pass
    pooled = F.array_compact(F.array(*(F.when(F.coalesce(*(F.col(f"edge_post_landform_{y}_{x}") for y in products.EPOCHS)) == 1, F.lit(x)) for x in products.LABELS)))
    touched = regrid.overlaps(df.where(inside).select("mountain_id", "row_idx", "col_idx", F.explode(pooled).alias("label"))).select("mountain_id", "label", "crow", "ccol").distinct()
    units = touched.join(climate, ["crow", "ccol"]).where("bio01_raw IS NOT NULL")
    limits = thresholds.otsu(thresholds.histogram(units, ["mountain_id", "label"], "bio01_raw"), ["mountain_id", "label"], least=samples)
    per = limits.groupBy("mountain_id").pivot("label", list(products.LABELS)).agg(F.max(F.when(F.col("valid") == 1, F.col("threshold_c"))))
    celsius = climate.select("crow", "ccol", (F.col("bio01_raw") * thresholds.SCALE + thresholds.OFFSET).alias("_t"))
    df = regrid.with_nearest(df).join(celsius, ["crow", "ccol"], "left").drop("crow", "ccol").join(per.withColumnsRenamed({x: f"_limit_{x}" for x in products.LABELS}), "mountain_id", "left")
    df = df.withColumns({f"otsu_valid_{x}": F.col(f"_limit_{x}").isNotNull().cast("int") for x in products.LABELS})
    df = df.withColumns({f"cold_zone_{x}": F.coalesce((F.col("_t") <= F.col(f"_limit_{x}")).cast("int"), F.lit(0)) for x in products.LABELS})
    # the six sums of all four forest bands share two passes, inside each mountain
    z = F.col("elevation").cast("long")
    of = lambda y, x, kind: inside & (F.col(name(y, x)) == kind) & z.isNotNull()
    sums = {f"_{s}{kind}_{y}_{x}": F.when(of(y, x, kind), v) for y, x in kinds for kind in (1, 0) for s, v in (("n", F.lit(1)), ("s", z), ("q", z * z))}
    df = stencil.box_sums(df, sums, k, ["mountain_id"])
    out = {}
    for y, x in kinds:
        f, n = ([F.col(f"_{s}{kind}_{y}_{x}") for s in "nsq"] for kind in (1, 0))
        test = welch(*f, *n)
        candidate = F.when((F.col(f"edge_post_landform_{y}_{x}") == 1) & (F.col(f"cold_zone_{x}") == 1), 1)
        out |= {f"upper_{y}_{x}": upper(candidate, f[0], n[0], test, least, rise), f"elevation_difference_{y}_{x}_m": test["difference"], f"t_statistic_{y}_{x}": test["t"], f"forest_sample_count_{y}_{x}": f[0], f"nonforest_sample_count_{y}_{x}": n[0], f"forest_clean_{y}_{x}": F.when(inside, F.col(name(y, x)))}
    df = df.withColumns(out).withColumns({f"treeline_{y}_{x}_m": F.when(F.col(f"upper_{y}_{x}") == 1, F.col("elevation")).cast("float") for y, x in kinds})
    df = df.withColumns({"analysis_domain": inside.cast("int"), "gmba_mask": inside.cast("int"), "sayre_high": F.when(inside, 1), "dem_elevation_m": F.col("elevation")})
    mine = df.where(inside)
    keys = ["mountain_id", "row_idx", "col_idx"]
    return {
        "treeline30m": mine.select(*keys, *products.product_bands()["treeline30m"]),
        "treeline1km": regrid.treeline_shift(mine, list(products.LABELS), ["mountain_id"]),
        "qa30m": products.qa_stack(mine, keys),
        "thresholds": limits,
    }


def plan_bytes(df: DataFrame) -> int:
    """Size of the analysed plan's text: a check before anything runs."""
    return len(df._jdf.queryExecution().analyzed().toString().encode())
