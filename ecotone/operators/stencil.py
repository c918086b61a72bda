"""Neighbourhood operators on dense lattices.

Square windows are separable: sums along rows, then along columns.  Each pass
is one shuffle by whole rows or columns, so no cell needs a halo, and several
bands and statistics share the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(row_first: bool, keys: list[str], k: int):
    by, order = ("row_idx", "col_idx") if row_first else ("col_idx", "row_idx")
    return Window.partitionBy(*keys, by).orderBy(order).rangeBetween(-k, k)


def box_sums(df: DataFrame, values: dict[str, Column], k: int, keys: list[str] | None = None, rows_first: bool = True) -> DataFrame:
    """df with the sum of each value over the (2k+1) x (2k+1) cells around; nulls add nothing, no valid cell gives 0.

    The passes commute: an operator that follows another begins with the axis
    by which the rows already lie, and saves a shuffle and a sort.
    """
    keys = keys or []
    one, two = _along(rows_first, keys, k), _along(not rows_first, keys, k)
    df = df.withColumns({n: F.coalesce(v, F.lit(0)) for n, v in values.items()})
    df = df.withColumns({n: F.sum(n).over(one) for n in values})
    return df.withColumns({n: F.sum(n).over(two) for n in values})


def focal_median(df: DataFrame, bands: list[str], k: int = 1, tie: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Median of the valid 0/1 cells around each cell; an even split gives `tie`, no valid cell null."""
    sums = box_sums(df, {**{f"_s_{b}": F.col(b).cast("int") for b in bands}, **{f"_n_{b}": F.col(b).isNotNull().cast("int") for b in bands}}, k, keys)
    out = {b: F.when(F.col(f"_n_{b}") == 0, None).when(2 * F.col(f"_s_{b}") > F.col(f"_n_{b}"), 1.0).when(2 * F.col(f"_s_{b}") < F.col(f"_n_{b}"), 0.0).otherwise(F.lit(tie)) for b in bands}
    return sums.withColumns(out).drop(*(f"_s_{b}" for b in bands), *(f"_n_{b}" for b in bands))


def laplacian8(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Sum over the valid neighbours of neighbour minus centre; null where the centre is."""
    sums = box_sums(df, {**{f"_s_{b}": F.col(b) for b in bands}, **{f"_n_{b}": F.col(b).isNotNull().cast("int") for b in bands}}, 1, keys, rows_first=False)
    return sums.withColumns({b: F.col(f"_s_{b}") - F.col(f"_n_{b}") * F.col(b) for b in bands}).drop(*(f"_s_{b}" for b in bands), *(f"_n_{b}" for b in bands))


def zero_crossing(df: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """1 where the sign differs from that of the right or the lower neighbour, else 0; null where the cell is."""
    keys = keys or []
    right, down = Window.partitionBy(*keys, "row_idx").orderBy("col_idx"), Window.partitionBy(*keys, "col_idx").orderBy("row_idx")
    df = df.withColumns({f"_r_{b}": F.signum(F.lead(b).over(right)) for b in bands})
    df = df.withColumns({f"_d_{b}": F.signum(F.lead(b).over(down)) for b in bands})
    differs = lambda b: F.coalesce(F.signum(b) != F.col(f"_r_{b}"), F.lit(False)) | F.coalesce(F.signum(b) != F.col(f"_d_{b}"), F.lit(False))
    return df.withColumns({b: F.when(F.col(b).isNotNull(), differs(b).cast("int")) for b in bands}).drop(*(f"_r_{b}" for b in bands), *(f"_d_{b}" for b in bands))


def forest_edges(df: DataFrame, bands: list[str], radius: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Median, Laplacian, zero crossing, for several bands at once and before any mask of the domain; four shuffles in all."""
    return zero_crossing(laplacian8(focal_median(df, bands, radius, keys=keys), bands, keys), bands, keys)


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of a Gaussian at distances -r .. r, r being three sigma, rounded to a millionth."""
    from math import ceil, exp

    r = max(1, ceil(3 * sigma))
    raw = [exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [round(v / sum(raw), 6) for v in raw]


def _weighted(df: DataFrame, band: str, weights: list[float], by: str, order: str, keys: list[str]) -> Column:
    """Weighted sum along one axis; a missing neighbour takes the centre's value."""
    w, r = Window.partitionBy(*keys, by).orderBy(order), len(weights) // 2
    near = [F.coalesce(F.lag(band, -d).over(w) if d < 0 else F.lead(band, d).over(w) if d > 0 else F.col(band), F.col(band)) for d in range(-r, r + 1)]
    total = near[0] * weights[0]
    for x, v in zip(near[1:], weights[1:], strict=True):
        total = total + x * v
    return total


def canny(df: DataFrame, band: str, threshold: float, sigma: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """df with `gradient` and `edge`: 1 where the smoothed band's gradient exceeds the threshold and is the largest across the edge.

    Smoothing is separable; the gradient is central, and its direction, in
    steps of 45 degrees, names the two neighbours that it must not fall below.
    """
    keys = keys or []
    w = gaussian_weights(sigma)
    df = df.withColumn("_g", F.col(band).cast("double"))
    df = df.withColumn("_g", _weighted(df, "_g", w, "row_idx", "col_idx", keys))
    df = df.withColumn("_g", _weighted(df, "_g", w, "col_idx", "row_idx", keys))
    right, down = Window.partitionBy(*keys, "row_idx").orderBy("col_idx"), Window.partitionBy(*keys, "col_idx").orderBy("row_idx")
    edge = lambda c, o: F.coalesce(c, o)
    df = df.withColumn("_x", edge(F.lead("_g").over(right), F.col("_g")) - edge(F.lag("_g").over(right), F.col("_g")))
    df = df.withColumn("_y", edge(F.lead("_g").over(down), F.col("_g")) - edge(F.lag("_g").over(down), F.col("_g")))
    df = df.withColumn("gradient", F.round(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")) / 2, 9))
    steep, flat = 2.414213562373095, 0.41421356237309503
    ax, ay = F.abs("_x"), F.abs("_y")
    # neighbours along the gradient: left/right, up/down, or one of the diagonals
    df = df.withColumns({"_l": F.lag("gradient").over(right), "_rr": F.lead("gradient").over(right)})
    df = df.withColumns({"_u": F.lag("gradient").over(down), "_dd": F.lead("gradient").over(down), "_ul": F.lag("_l").over(down), "_dr": F.lead("_rr").over(down), "_ur": F.lag("_rr").over(down), "_dl": F.lead("_l").over(down)})
    a = F.when(ay <= ax * flat, F.col("_l")).when(ay >= ax * steep, F.col("_u")).when(F.col("_x") * F.col("_y") > 0, F.col("_ul")).otherwise(F.col("_ur"))
    b = F.when(ay <= ax * flat, F.col("_rr")).when(ay >= ax * steep, F.col("_dd")).when(F.col("_x") * F.col("_y") > 0, F.col("_dr")).otherwise(F.col("_dl"))
    top = (F.col("gradient") > threshold) & (F.col("gradient") >= F.coalesce(a, F.lit(0.0))) & (F.col("gradient") >= F.coalesce(b, F.lit(0.0)))
    return df.withColumn("edge", F.when(F.col("gradient").isNotNull(), top.cast("int"))).drop("_g", "_x", "_y", "_l", "_rr", "_u", "_dd", "_ul", "_dr", "_ur", "_dl")


def slope_aspect(df: DataFrame, band: str, cell_x: Column, cell_y: Column, keys: list[str] | None = None) -> DataFrame:
    """df with slope and aspect in degrees by Horn's 3 x 3 gradient; null where a neighbour is. Aspect: 0 north, clockwise."""
    keys = keys or []
    right, down = Window.partitionBy(*keys, "row_idx").orderBy("col_idx"), Window.partitionBy(*keys, "col_idx").orderBy("row_idx")
    z = F.col(band).cast("double")
    df = df.withColumns({"_e": F.lead(z).over(right), "_w": F.lag(z).over(right)})
    df = df.withColumns({"_dx": F.col("_e") - F.col("_w"), "_sx": F.col("_w") + 2 * z + F.col("_e")})
    df = df.withColumns({"_n": F.lag("_sx").over(down), "_s": F.lead("_sx").over(down), "_dn": F.lag("_dx").over(down), "_ds": F.lead("_dx").over(down)})
    gx = (F.col("_dn") + 2 * F.col("_dx") + F.col("_ds")) / (8 * cell_x)
    gy = (F.col("_n") - F.col("_s")) / (8 * cell_y)  # northwards
    df = df.withColumns({"_gx": gx, "_gy": gy})
    slope = F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))
    turn = F.degrees(F.atan2(-F.col("_gx"), -F.col("_gy")))
    aspect = F.when((F.col("_gx") == 0) & (F.col("_gy") == 0), 0.0).when(turn < 0, turn + 360).otherwise(turn)
    return df.withColumns({"slope": slope, "aspect": F.when(F.col("_gx").isNotNull() & F.col("_gy").isNotNull(), aspect)}).drop("_e", "_w", "_dx", "_sx", "_n", "_s", "_dn", "_ds", "_gx", "_gy")


def aspect_class(aspect: Column, slope: Column, latitude: Column, half: float = 45.0, least_slope: float = 5.0, equator: float = 0.1) -> Column:
    """1 facing the pole, 2 facing the equator, 0 neither; null where the aspect is."""
    north = (aspect >= 360 - half) | (aspect < half)
    south = (aspect >= 180 - half) & (aspect < 180 + half)
    upper, lower, steep = latitude > equator, latitude < -equator, slope >= least_slope
    out = F.when(((upper & south) | (lower & north)) & steep, 2).when(((upper & north) | (lower & south)) & steep, 1).otherwise(0)
    return F.when(aspect.isNotNull() & slope.isNotNull(), out)
