"""From cleaned forest and elevation to candidate edges, treeline bands, quality layers and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecotone.functions.masks import update_mask
from ecotone.functions.tests import pooled, upper, welch
from ecotone.operators.stencil import box_sums

LABELS, EPOCHS = ("h3m", "h5m"), (2000, 2020)
#: Landform classes of valleys, and the fill of unmasked DEM bands.
VALLEY_CLASSES = (41, 42)
NO_DEM_MASK, NO_DEM_STACK = 255, 0


def mosaic(df: DataFrame, bands: list[str], priority: str) -> DataFrame:
    """Per cell and band the valid value of the image with the highest priority."""
    return df.groupBy("row_idx", "col_idx").agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), F.col(priority))).alias(b) for b in bands))


def collection_max(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.groupBy("row_idx", "col_idx").agg(*(F.max(b).alias(b) for b in bands))


def dem(df: DataFrame, elevation: str, mask: str, strict: bool = False) -> DataFrame:
    """df with `elevation` masked where the mask is 1, or strictly wherever it is not 0."""
    fine = F.col(mask) == 0 if strict else F.col(mask) != 1
    return df.withColumn("elevation", F.when(fine, F.col(elevation)))


def select_mountains(df: DataFrame, key: str, unit: str = "MapUnit", kind: str = "Basic", hm: str = "hm_fraction", tree: str = "tree_fraction", least: float = 0.5, most: float = 0.9) -> DataFrame:
    """Mountains of the kind with enough high mountain and not too much tree cover, both limits included, with a text key and a sort key."""
    got = df.where((F.col(unit) == kind) & (F.col(hm) >= least) & (F.col(tree) <= most))
    return got.withColumns({"mountain_key": F.round(F.col(key)).cast("long").cast("string"), "sort_key": F.col(key).cast("double")})


def keep_first(left: DataFrame, right: DataFrame, key: str, order: Column) -> DataFrame:
    """left with the first of right's rows for its key; rows without one go."""
    cols = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    return left.join(first, key)


def upper_edges(df: DataFrame, forest: str, elevation: str, candidate: str, domain: str, k: int = 5, method: str = "welch", sided: int = 1, least: int = 5, rise: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """df with difference, t, forest_count, nonforest_count and `upper`.

    Both samples lie in the square around each cell, within the domain; the six
    sums of both share two passes.  Elevations are integers, so equal ones give
    a variance of exactly zero.
    """
    z = F.col(elevation).cast("long")
    of = lambda kind: (F.col(forest) == kind) & (F.col(domain) == 1) & z.isNotNull()
    sums = {f"_{s}{kind}": F.when(of(kind), v) for kind in (1, 0) for s, v in (("n", F.lit(1)), ("s", z), ("q", z * z))}
    got = box_sums(df, sums, k, keys)
    f, n = ([F.col(f"_{s}{kind}") for s in "nsq"] for kind in (1, 0))
    test = (welch if method == "welch" else pooled)(*f, *n)
    return got.withColumns({"difference": test["difference"], "t": test["t"], "df": test["df"], "forest_count": f[0], "nonforest_count": n[0], "upper": upper(F.col(candidate), f[0], n[0], test, least, rise, sided)}).drop(*sums)


def candidates(df: DataFrame, edge: str, domain: str, nonvalley: str) -> DataFrame:
    """df with candidate (edge within the domain) and post_landform (also off the valleys), 1 or null."""
    got = df.withColumn("candidate", F.when((F.col(edge) == 1) & (F.col(domain) == 1), 1))
    return got.withColumn("post_landform", F.when((F.col("candidate") == 1) & (F.col(nonvalley) == 1), 1))


def product_bands() -> dict[str, list[str]]:
    """Bands of the three products, in order."""
    fine = [f"treeline_{y}_{x}_m" for x in LABELS for y in EPOCHS]
    coarse = [b for x in LABELS for b in (*(f"treeline_{y}_{x}_mean_m" for y in EPOCHS), f"shift_2000_2020_{x}_m_per_year")]
    each = ("forest_clean_{}", "candidate_edge_{}", "edge_post_landform_{}", "upper_{}", "elevation_difference_{}_m", "t_statistic_{}", "forest_sample_count_{}", "nonforest_sample_count_{}")
    qa = ["analysis_domain", "sayre_high", "gmba_mask", "hm_fraction", "tree_fraction", "non_valley", "dem_elevation_m", "dem_msk", "dem_stk"]
    for x in LABELS:
        qa += [b.format(f"{y}_{x}") for y in EPOCHS for b in each] + [f"cold_zone_{x}", f"otsu_valid_{x}"]
    return {"treeline30m": fine, "treeline1km": coarse, "qa30m": qa}


def qa_stack(df: DataFrame, keys: list[str]) -> DataFrame:
    """The quality bands in order, unfilled ones as they are: 0 for classes and flags, 255 for the DEM's mask."""
    filled = {"dem_msk": NO_DEM_MASK, "dem_stk": NO_DEM_STACK, "analysis_domain": 0, "gmba_mask": 0, "non_valley": 0}
    out = []
    for b in product_bands()["qa30m"]:
        flag = b in filled or b.startswith(("forest_clean_", "candidate_edge_", "edge_post_landform_", "upper_", "cold_zone_"))
        out.append(F.coalesce(F.col(b), F.lit(filled.get(b, 0))).alias(b) if flag else F.col(b))
    return df.select(*keys, *out)


def pyramid(df: DataFrame, means: list[str], modes: list[str], level: int = 1) -> DataFrame:
    """The overview `level` steps up: 2 x 2 cells give the mean, or the mode (the smallest of the most frequent)."""
    for _ in range(level):
        at = [F.floor(F.col(c) / 2).alias(c) for c in ("row_idx", "col_idx")]
        got = df.groupBy(*at).agg(*(F.avg(b).alias(b) for b in means), *(F.array_sort(F.collect_list(b)).alias(b) for b in modes))
        # at most four values a cell
        count = lambda vs, v: F.size(F.filter(vs, lambda o: o == v))
        best = lambda b: F.array_max(F.transform(F.col(b), lambda v: F.struct(count(F.col(b), v).alias("n"), (-v).alias("v"))))
        df = got.withColumns({b: -best(b)["v"] for b in modes})
    return df


def treeline(df: DataFrame, elevation: str = "elevation", upper_band: str = "upper") -> DataFrame:
    """df with `treeline`: the elevation at upper edges."""
    return df.withColumn("treeline", update_mask(F.col(elevation), F.col(upper_band)))


def tagged_union(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows of several tables with the name of their source."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Requested ids in order of first request, each once."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of two sets has."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))
