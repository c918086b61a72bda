"""Every registered query of the engine, with the SQL it is held against.

The tables have no rasters, so events stand for a lattice of a hundred columns:
the event's number gives row and column, its value the canopy or raw climate
unit, an order of the same number the elevation; errors are masked cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecotone.functions import masks, scalars, tests
from ecotone.functions.grid import CLIMATE, FINE, tile_id
from ecotone.operators import compare, components, products, regrid, stencil, thresholds, vector
from ecotone.plans import control, validation

WIDTH = 100
#: The lattice's first row on the fine grid: the equator.
ROW0 = 360_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LAT = """lat AS (SELECT event_id // 100 AS r, event_id % 100 AS c, event_id AS id, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS v, CAST(round(o_totalprice) AS BIGINT) AS z, CAST(round(o_totalprice * 100) AS BIGINT) AS p
  FROM events LEFT JOIN orders ON o_orderkey = event_id)"""


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, col_idx, event_type, user_id, cents, v (masked cents), z (elevation), p (price in cents)."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.select("event_id", F.floor(F.col("event_id") / WIDTH).alias("row_idx"), (F.col("event_id") % WIDTH).alias("col_idx"), "event_type", "user_id", cents.alias("cents"), F.when(F.col("event_type") != "error", cents).alias("v"))
    o = o.select(F.col("o_orderkey").alias("event_id"), F.round("o_totalprice").cast("long").alias("z"), F.round(F.col("o_totalprice") * 100).cast("long").alias("p"))
    return e.join(o, "event_id", "left").drop("event_id")


def forest(df: DataFrame, cut: int = 6000) -> DataFrame:
    return df.withColumn("forest", (F.col("v") > cut).cast("int"))


# grids, masks, scalars


@query("""SELECT concat(CASE WHEN y >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs(y) AS VARCHAR), 2, '0'), '_', CASE WHEN x >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(x) AS VARCHAR), 3, '0')) AS tile_id,
  CAST(x AS DOUBLE) AS min_lon, CAST(x + 10 AS DOUBLE) AS max_lon, CAST(y AS DOUBLE) AS min_lat, CAST(y + 10 AS DOUBLE) AS max_lat
  FROM (SELECT unnest(range(-60, 80, 10)) AS y) a, (SELECT unnest(range(-180, 180, 10)) AS x) b""")
def regular_tiles(spark, sf_dir):
    return vector.regular_tiles(spark)


@query(f"""WITH {LAT} SELECT r AS row_idx, c AS col_idx, CASE WHEN v > 6000 THEN 1 END AS self_masked, CASE WHEN cents % 2 = 1 THEN v END AS updated, coalesce(v, 255) AS unmasked,
  CASE WHEN v IS NOT NULL THEN CAST(v > 6000 AND z > 250000 AS INT) END AS both, CASE WHEN v IS NOT NULL THEN CAST(v > 6000 OR z > 250000 AS INT) END AS either_one, CASE WHEN v IS NOT NULL THEN CAST(v <= 6000 AS INT) END AS inverted,
  CASE WHEN cents % 7 = 3 THEN 2 WHEN cents % 7 = 2 OR cents % 7 = 3 THEN 1 ELSE 0 END AS replaced, CASE WHEN v IS NOT NULL THEN CAST(v % 50 IN (41, 42) AS INT) END AS in_class FROM lat""")
def mask_algebra(spark, sf_dir):
    df = forest(lattice(spark, sf_dir)).withColumn("high", (F.col("z") > 250000).cast("int"))
    f, h, k = F.col("forest"), F.col("high"), F.col("cents") % 7
    return df.select("row_idx", "col_idx", masks.self_mask(f).alias("self_masked"), masks.update_mask(F.col("v"), F.col("cents") % 2).alias("updated"), masks.unmask(F.col("v"), 255).alias("unmasked"), masks.both(f, h).alias("both"), masks.either(f, h).alias("either_one"), masks.invert(f).alias("inverted"), masks.replaced(0, (k.isin(2, 3), 1), (k == 3, 2)).alias("replaced"), masks.class_mask(F.col("v") % 50, products.VALLEY_CLASSES).alias("in_class"))


@query(f"""WITH {LAT} SELECT r AS row_idx, c AS col_idx, least(v IS NOT NULL, z IS NOT NULL)::INT AS valid, round(90 - (r + 360000 + 0.5) * 0.00025, 9) AS latitude, round(-180 + (c + 0.5) * 0.00025, 9) AS longitude,
  round(pow(6371008.8 * 0.017453292519943295 * 0.00025, 2) * cos(radians(90 - (r + 360000 + 0.5) * 0.00025)), 4) AS area_m2, CAST(floor(3 * (2 * r + 1) / 200.0) AS BIGINT) AS crow, CAST(floor(3 * (2 * c + 1) / 200.0) AS BIGINT) AS ccol, round(cents * 0.1 - 273.15, 6) AS celsius FROM lat""")
def grid_geometry(spark, sf_dir):
    row = F.col("row_idx") + ROW0
    df = regrid.with_nearest(lattice(spark, sf_dir))
    return df.select("row_idx", "col_idx", masks.common_mask(F.col("v"), F.col("z")).alias("valid"), F.round(FINE.latitude(row), 9).alias("latitude"), F.round(FINE.longitude(F.col("col_idx")), 9).alias("longitude"), F.round(FINE.area(row), 4).alias("area_m2"), "crow", "ccol", F.round(scalars.linear(F.col("cents"), 0.1, -273.15), 6).alias("celsius"))


@query("""SELECT p_partkey, CASE WHEN s <> '' THEN s END AS safe, CAST(CAST(p_partkey AS BIGINT) AS VARCHAR) AS id_text, concat('h', replace(CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END, '.', 'p'), 'm') AS label FROM (
  SELECT p_partkey, p_size / 2.0 AS m, regexp_replace(regexp_replace(concat(' ', p_name, '#', p_brand, '! '), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part) t""")
def name_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.safe_name(F.concat(F.lit(" "), "p_name", F.lit("#"), "p_brand", F.lit("! "))).alias("safe"), scalars.id_text(F.col("p_partkey").cast("double")).alias("id_text"), scalars.threshold_label(F.col("p_size") / 2).alias("label"))


# neighbourhoods

NEAR = """n8(dr, dc) AS (SELECT a, b FROM (SELECT unnest([-1, 0, 1]) AS a) x, (SELECT unnest([-1, 0, 1]) AS b) y)"""
MEDIAN = f"""{LAT}, {NEAR}, f AS (SELECT r, c, CAST(v > 6000 AS INT) AS forest FROM lat),
  med AS (SELECT a.r, a.c, CASE WHEN count(b.forest) = 0 THEN NULL WHEN 2 * sum(b.forest) > count(b.forest) THEN 1.0 WHEN 2 * sum(b.forest) < count(b.forest) THEN 0.0 ELSE 0.5 END::DOUBLE AS m FROM f a, n8 JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c),
  lap AS (SELECT a.r, a.c, CASE WHEN a.m IS NOT NULL THEN sum(b.m - a.m) END AS l FROM med a, n8 JOIN med b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c, a.m),
  zero AS (SELECT a.r, a.c, CASE WHEN a.l IS NOT NULL THEN CAST(coalesce(sign(a.l) <> sign(b.l), false) OR coalesce(sign(a.l) <> sign(d.l), false) AS INT) END AS e FROM lap a LEFT JOIN lap b ON b.r = a.r AND b.c = a.c + 1 LEFT JOIN lap d ON d.r = a.r + 1 AND d.c = a.c)"""
MEDIAN = MEDIAN.replace("FROM f a, n8 JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc", "FROM (SELECT * FROM f, n8) a JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc").replace("FROM med a, n8 JOIN med b ON", "FROM (SELECT * FROM med, n8) a JOIN med b ON")


@query(f"WITH {MEDIAN} SELECT r AS row_idx, c AS col_idx, m AS median FROM med")
def focal_median(spark, sf_dir):
    return stencil.focal_median(forest(lattice(spark, sf_dir)), ["forest"]).select("row_idx", "col_idx", F.col("forest").alias("median"))


@query(f"WITH {MEDIAN} SELECT r AS row_idx, c AS col_idx, l AS laplacian FROM lap")
def laplacian(spark, sf_dir):
    df = stencil.focal_median(forest(lattice(spark, sf_dir)), ["forest"])
    return stencil.laplacian8(df, ["forest"]).select("row_idx", "col_idx", F.col("forest").alias("laplacian"))


@query(f"WITH {MEDIAN} SELECT r AS row_idx, c AS col_idx, e AS edge FROM zero")
def forest_edge(spark, sf_dir):
    return stencil.forest_edges(forest(lattice(spark, sf_dir)), ["forest"]).select("row_idx", "col_idx", F.col("forest").alias("edge"))


WINDOW = f"""{LAT}, a AS (SELECT r, c, CAST(v > 6000 AS INT) AS forest, z, CAST(user_id % 10 <> 0 AS INT) AS domain, CASE WHEN v % 3 = 0 THEN 1 END AS cand FROM lat),
  sums AS (SELECT a.r, a.c, any_value(a.cand) AS cand, CAST(count(CASE WHEN b.forest = 1 THEN b.z END) AS BIGINT) AS nf, CAST(coalesce(sum(CASE WHEN b.forest = 1 THEN b.z END), 0) AS BIGINT) AS sf, CAST(coalesce(sum(CASE WHEN b.forest = 1 THEN b.z * b.z END), 0) AS BIGINT) AS qf,
    CAST(count(CASE WHEN b.forest = 0 THEN b.z END) AS BIGINT) AS nn, CAST(coalesce(sum(CASE WHEN b.forest = 0 THEN b.z END), 0) AS BIGINT) AS sn, CAST(coalesce(sum(CASE WHEN b.forest = 0 THEN b.z * b.z END), 0) AS BIGINT) AS qn
    FROM (SELECT *, unnest(range(-5, 6)) AS dr FROM a) a JOIN (SELECT * FROM a WHERE domain = 1) b ON b.r = a.r + a.dr AND b.c BETWEEN a.c - 5 AND a.c + 5 GROUP BY a.r, a.c),
  every AS (SELECT a.r, a.c, a.cand, coalesce(nf, 0) AS nf, coalesce(sf, 0) AS sf, coalesce(qf, 0) AS qf, coalesce(nn, 0) AS nn, coalesce(sn, 0) AS sn, coalesce(qn, 0) AS qn FROM a LEFT JOIN sums USING (r, c)),
  var AS (SELECT *, CASE WHEN nf > 0 THEN sf / nf::DOUBLE END AS mf, CASE WHEN nn > 0 THEN sn / nn::DOUBLE END AS mn, CASE WHEN nf > 0 THEN (nf::HUGEINT * qf - sf::HUGEINT * sf)::DOUBLE / (nf * nf) END AS vf, CASE WHEN nn > 0 THEN (nn::HUGEINT * qn - sn::HUGEINT * sn)::DOUBLE / (nn * nn) END AS vn FROM every),
  test AS (SELECT *, mn - mf AS diff, sqrt(vf / nf + vn / nn) AS se, pow(vf / nf + vn / nn, 2) / nullif(pow(vf / nf, 2) / nullif(nf - 1, 0) + pow(vn / nn, 2) / nullif(nn - 1, 0), 0) AS df,
    sqrt((vf * nf + vn * nn) / nullif(nf + nn - 2, 0) * (1.0 / nullif(nf, 0) + 1.0 / nullif(nn, 0))) AS pse, CAST(nf + nn - 2 AS DOUBLE) AS pdf FROM var)"""


def _critical(table) -> str:
    return "CASE " + " ".join(f"WHEN df >= {d} THEN {t}" for d, t in reversed(table[1:])) + f" ELSE {table[0][1]} END"


def _upper_sql(df: str, se: str, sided) -> str:
    return f"""WITH {WINDOW}, u AS (SELECT r, c, cand, nf, nn, diff, {df} AS df, {se} AS se, (mf - mn) / nullif({se}, 0) AS t FROM test)
  SELECT r AS row_idx, c AS col_idx, nf AS forest_count, nn AS nonforest_count, round(diff, 6) AS difference, round(t, 6) AS t,
  CAST(coalesce(cand = 1 AND nf >= 5 AND nn >= 5 AND se > 0 AND diff >= 0 AND t < {_critical(sided)}, false) AS INT) AS upper FROM u"""


def _tested(spark, sf_dir, **how) -> DataFrame:
    df = forest(lattice(spark, sf_dir)).withColumns({"domain": (F.col("user_id") % 10 != 0).cast("int"), "cand": F.when(F.col("v") % 3 == 0, 1)})
    got = products.upper_edges(df, "forest", "z", "cand", "domain", **how)
    return got.select("row_idx", "col_idx", "forest_count", "nonforest_count", F.round("difference", 6).alias("difference"), F.round("t", 6).alias("t"), "upper")


@query(_upper_sql("df", "se", tests.ONE_SIDED))
def welch_upper(spark, sf_dir):
    return _tested(spark, sf_dir)


@query(_upper_sql("pdf", "pse", tests.ONE_SIDED))
def pooled_upper(spark, sf_dir):
    return _tested(spark, sf_dir, method="pooled")


@query(_upper_sql("df", "se", tests.TWO_SIDED))
def two_sided_upper(spark, sf_dir):
    return _tested(spark, sf_dir, sided=2)


@query(f"""WITH {WINDOW} SELECT r AS row_idx, c AS col_idx, nf AS n, round(mf, 6) AS mean, round(vf, 4) AS variance FROM var""")
def window_stats(spark, sf_dir):
    df = forest(lattice(spark, sf_dir)).withColumn("x", F.when((F.col("forest") == 1) & (F.col("user_id") % 10 != 0), F.col("z")))
    got = stencil.box_sums(df, {"n": F.col("x").isNotNull().cast("long"), "s": F.col("x"), "q": F.col("x") * F.col("x")}, 5)
    return got.select("row_idx", "col_idx", "n", F.round(tests.mean(F.col("n"), F.col("s")), 6).alias("mean"), F.round(tests.variance(F.col("n"), F.col("s"), F.col("q")), 4).alias("variance"))


@query("""SELECT event_id, CASE """ + " ".join(f"WHEN value >= {d} THEN {t}" for d, t in reversed(tests.ONE_SIDED[1:])) + f""" ELSE {tests.ONE_SIDED[0][1]} END::DOUBLE AS one_sided, CASE """ + " ".join(f"WHEN value >= {d} THEN {t}" for d, t in reversed(tests.TWO_SIDED[1:])) + f""" ELSE {tests.TWO_SIDED[0][1]} END::DOUBLE AS two_sided FROM events""")
def critical_t(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tests.critical_t(F.col("value")).alias("one_sided"), tests.critical_t(F.col("value"), 2).alias("two_sided"))


HORN = f"""{LAT}, h AS (SELECT r, c, z::DOUBLE AS z, lead(z) OVER x AS e, lag(z) OVER x AS w FROM lat WINDOW x AS (PARTITION BY r ORDER BY c)),
  g AS (SELECT *, e - w AS dx, w + 2 * z + e AS sx FROM h), k AS (SELECT r, c, (lag(dx) OVER y + 2 * dx + lead(dx) OVER y) / 240000.0 AS gx, (lag(sx) OVER y - lead(sx) OVER y) / 240000.0 AS gy FROM g WINDOW y AS (PARTITION BY c ORDER BY r)),
  s AS (SELECT r, c, gx, gy, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, -gy)) AS turn FROM k),
  t AS (SELECT r, c, slope, CASE WHEN gx IS NULL OR gy IS NULL THEN NULL WHEN gx = 0 AND gy = 0 THEN 0 WHEN turn < 0 THEN turn + 360 ELSE turn END AS aspect, CASE WHEN r < 50 THEN 1 ELSE -1 END AS lat FROM s)"""


@query(f"""WITH {HORN} SELECT r AS row_idx, c AS col_idx, round(slope, 6) AS slope, round(aspect, 6) AS aspect,
  CASE WHEN aspect IS NULL OR slope IS NULL THEN NULL WHEN slope >= 5 AND ((lat > 0.1 AND aspect >= 135 AND aspect < 225) OR (lat < -0.1 AND (aspect >= 315 OR aspect < 45))) THEN 2
  WHEN slope >= 5 AND ((lat > 0.1 AND (aspect >= 315 OR aspect < 45)) OR (lat < -0.1 AND aspect >= 135 AND aspect < 225)) THEN 1 ELSE 0 END AS aspect_class FROM t""")
def aspect_groups(spark, sf_dir):
    df = stencil.slope_aspect(lattice(spark, sf_dir), "z", F.lit(30000.0), F.lit(30000.0))
    lat = F.when(F.col("row_idx") < 50, 1).otherwise(-1)
    return df.select("row_idx", "col_idx", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"), stencil.aspect_class(F.col("aspect"), F.col("slope"), lat).alias("aspect_class"))


def _canny_sql() -> str:
    w = stencil.gaussian_weights(1.0)
    r = len(w) // 2

    def blur(src, by, order):
        terms = " + ".join(f"coalesce({'lag' if d < 0 else 'lead'}(g, {abs(d)}) OVER o, g) * {w[d + r]}" if d else f"g * {w[r]}" for d in range(-r, r + 1))
        return f"SELECT r, c, {terms} AS g FROM {src} WINDOW o AS (PARTITION BY {by} ORDER BY {order})"

    return f"""WITH {LAT}, b0 AS (SELECT r, c, cents::DOUBLE AS g FROM lat), b1 AS ({blur('b0', 'r', 'c')}), b2 AS ({blur('b1', 'c', 'r')}),
  d1 AS (SELECT r, c, coalesce(lead(g) OVER x, g) - coalesce(lag(g) OVER x, g) AS dx, coalesce(lead(g) OVER y, g) - coalesce(lag(g) OVER y, g) AS dy FROM b2 WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)),
  d2 AS (SELECT r, c, dx, dy, round(sqrt(dx * dx + dy * dy) / 2, 9) AS m FROM d1),
  d3 AS (SELECT a.*, CASE WHEN abs(dy) <= abs(dx) * 0.41421356237309503 THEN 0 WHEN abs(dy) >= abs(dx) * 2.414213562373095 THEN 2 WHEN dx * dy > 0 THEN 1 ELSE 3 END AS k FROM d2 a),
  d4 AS (SELECT a.r, a.c, a.m, coalesce(p.m, 0) AS p, coalesce(q.m, 0) AS q FROM d3 a LEFT JOIN d2 p ON p.r = a.r + CASE k WHEN 0 THEN 0 ELSE -1 END AND p.c = a.c + CASE k WHEN 0 THEN -1 WHEN 2 THEN 0 WHEN 1 THEN -1 ELSE 1 END
    LEFT JOIN d2 q ON q.r = a.r + CASE k WHEN 0 THEN 0 ELSE 1 END AND q.c = a.c + CASE k WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE -1 END)
  SELECT r AS row_idx, c AS col_idx, round(m, 4) AS gradient, CAST(m > 800 AND m >= p AND m >= q AS INT) AS edge FROM d4"""


@query(_canny_sql())
def canny_edges(spark, sf_dir):
    df = stencil.canny(lattice(spark, sf_dir), "cents", 800.0)
    return df.select("row_idx", "col_idx", F.round("gradient", 4).alias("gradient"), "edge")


# regridding

BANDS4 = "CASE WHEN v > 2000 THEN v END AS treeline_2000_h3m_m, CASE WHEN p % 5 <> 0 THEN p END AS treeline_2020_h3m_m, CASE WHEN v > 4000 THEN v END AS treeline_2000_h5m_m, CASE WHEN p % 3 <> 0 THEN p END AS treeline_2020_h5m_m"
OVER = f"""{LAT}, b AS (SELECT r, c, v, {BANDS4} FROM lat),
  o AS (SELECT *, least(3 * r + 3, 100 * kr + 100) - greatest(3 * r, 100 * kr) AS wr, least(3 * c + 3, 100 * kc + 100) - greatest(3 * c, 100 * kc) AS wc FROM (SELECT *, unnest(range(3 * c // 100, (3 * c + 2) // 100 + 1)) AS kc FROM (SELECT *, unnest(range(3 * r // 100, (3 * r + 2) // 100 + 1)) AS kr FROM b) x) y)"""


def _bands4(df: DataFrame) -> DataFrame:
    v, p = F.col("v"), F.col("p")
    return df.withColumns({"treeline_2000_h3m_m": F.when(v > 2000, v), "treeline_2020_h3m_m": F.when(p % 5 != 0, p), "treeline_2000_h5m_m": F.when(v > 4000, v), "treeline_2020_h5m_m": F.when(p % 3 != 0, p)})


def _mean_sql(b: str) -> str:
    return f"sum({b} * wr * wc)::DOUBLE / nullif(sum(CASE WHEN {b} IS NOT NULL THEN wr * wc END), 0)"


@query(f"""WITH {OVER}, m AS (SELECT kr, kc, {', '.join(f'{_mean_sql(f"treeline_{y}_{x}_m")} AS m{y}_{x}' for x in products.LABELS for y in products.EPOCHS)} FROM o GROUP BY kr, kc)
  SELECT kr AS crow, kc AS ccol, {', '.join(f'round(m2000_{x}, 6) AS treeline_2000_{x}_mean_m, round(m2020_{x}, 6) AS treeline_2020_{x}_mean_m, round((m2020_{x} - m2000_{x}) / 20, 6) AS shift_2000_2020_{x}_m_per_year' for x in products.LABELS)} FROM m""")
def treeline_shift(spark, sf_dir):
    got = regrid.treeline_shift(_bands4(lattice(spark, sf_dir)), list(products.LABELS))
    return got.select("crow", "ccol", *(F.round(c, 6).alias(c) for c in got.columns[2:]))


@query(f"WITH {OVER} SELECT DISTINCT kr AS crow, kc AS ccol FROM o WHERE v > 30000")
def regrid_any(spark, sf_dir):
    return regrid.any_cell(lattice(spark, sf_dir).withColumn("hot", (F.col("v") > 30000).cast("int")), "hot")


@query(f"""WITH {OVER} SELECT kr AS crow, kc AS ccol, CAST(sum(wr * wc) AS BIGINT) AS weight, count(*) AS cells FROM o GROUP BY kr, kc""")
def overlap_weights(spark, sf_dir):
    return regrid.overlaps(lattice(spark, sf_dir).select("row_idx", "col_idx")).groupBy("crow", "ccol").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cells"))


BOX = (0.01, 0.005, 0.0175, 0.0125)


@query(f"""WITH {LAT}, f AS (SELECT (c + 0.5) * 0.00025::DOUBLE AS lon, (r + 0.5) * 0.00025::DOUBLE AS lat, v::DOUBLE AS a, CASE WHEN cents % 3 = 0 THEN p::DOUBLE END AS b FROM lat),
  w AS (SELECT *, least(1.0, greatest(least(lon + 0.000125, {BOX[2]}) - greatest(lon - 0.000125, {BOX[0]}), 0) * greatest(least(lat + 0.000125, {BOX[3]}) - greatest(lat - 0.000125, {BOX[1]}), 0) / 6.25e-8)::DOUBLE AS w FROM f)
  SELECT count(*) AS overlaps, round(sum(CASE WHEN a IS NOT NULL THEN w END), 4) AS a_weight, round(sum(CASE WHEN b IS NOT NULL THEN w END), 4) AS b_weight, round(sum(a * w) / sum(CASE WHEN a IS NOT NULL THEN w END), 2) AS a, round(sum(b * w) / sum(CASE WHEN b IS NOT NULL THEN w END), 0) AS b FROM w WHERE w > 1e-6""")
def overlap_sample(spark, sf_dir):
    df = lattice(spark, sf_dir).select(((F.col("col_idx") + 0.5) * 0.00025).alias("lon"), ((F.col("row_idx") + 0.5) * 0.00025).alias("lat"), F.col("v").cast("double").alias("a"), F.when(F.col("cents") % 3 == 0, F.col("p").cast("double")).alias("b"))
    # cells that touch the box with an edge only are left out: their overlap is rounding
    inside = df.where(f"lon > {BOX[0]} AND lon < {BOX[2]} AND lat > {BOX[1]} AND lat < {BOX[3]}")
    got = regrid.overlap_means(inside, ["a", "b"], cell=BOX)
    return got.select("overlaps", F.round("a_weight", 4).alias("a_weight"), F.round("b_weight", 4).alias("b_weight"), F.round("a", 2).alias("a"), F.round("b", 0).alias("b"))


# histograms and thresholds

HIST = f"""{LAT}, g AS (SELECT event_type AS mountain, cents AS x FROM lat WHERE event_type <> 'error'), s AS (SELECT mountain, min(x) AS lo, max(x) AS hi FROM g GROUP BY mountain),
  w AS (SELECT mountain, min(k) AS k FROM (SELECT mountain, lo, hi, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS k FROM s) t WHERE hi // k - lo // k + 1 <= 256 GROUP BY mountain),
  hist AS (SELECT mountain, x // k * k AS bucket, count(*)::DOUBLE AS n, avg(x) AS mean FROM g JOIN w USING (mountain) GROUP BY ALL),
  cum AS (SELECT *, row_number() OVER o AS i, count(*) OVER a AS size, sum(n) OVER o AS na, sum(n * mean) OVER o AS sa, sum(n) OVER a AS t, sum(n * mean) OVER a AS st FROM hist WINDOW o AS (PARTITION BY mountain ORDER BY bucket), a AS (PARTITION BY mountain)),
  scored AS (SELECT *, round(na * pow(sa / na - st / t, 2) + (t - na) * pow((st - sa) / nullif(t - na, 0) - st / t, 2), 6) AS score FROM cum WHERE i < size),
  best AS (SELECT mountain, arg_max(mean, score * 100000 + i) AS raw FROM scored GROUP BY mountain),
  otsu AS (SELECT c.mountain, CAST(max(size) >= 2 AND max(t) >= 20 AS INT) AS valid, any_value(raw) AS raw, max(t) AS samples, max(size) AS buckets FROM cum c LEFT JOIN best USING (mountain) GROUP BY c.mountain)"""


def _units(spark, sf_dir) -> DataFrame:
    return lattice(spark, sf_dir).where("event_type <> 'error'").select(F.col("event_type").alias("mountain"), "cents", "row_idx", "col_idx")


@query(f"WITH {HIST} SELECT mountain, bucket, n, round(mean, 6) AS mean FROM hist")
def temperature_histogram(spark, sf_dir):
    return thresholds.histogram(_units(spark, sf_dir), ["mountain"], "cents").select("mountain", "bucket", "n", F.round("mean", 6).alias("mean"))


@query(f"WITH {HIST} SELECT mountain, valid, round(raw, 6) AS threshold_raw, round(raw * 0.1 - 273.15, 6) AS threshold_c, samples, buckets FROM otsu")
def otsu_threshold(spark, sf_dir):
    got = thresholds.otsu(thresholds.histogram(_units(spark, sf_dir), ["mountain"], "cents"), ["mountain"])
    return got.select("mountain", "valid", F.round("threshold_raw", 6).alias("threshold_raw"), F.round("threshold_c", 6).alias("threshold_c"), "samples", "buckets")


@query(f"WITH {HIST} SELECT l.r AS row_idx, l.c AS col_idx, l.event_type AS mountain, CAST(valid = 1 AND l.cents * 0.1 - 273.15 <= raw * 0.1 - 273.15 AS INT) AS cold FROM lat l JOIN otsu o ON o.mountain = l.event_type")
def cold_zone(spark, sf_dir):
    units = _units(spark, sf_dir)
    limits = thresholds.otsu(thresholds.histogram(units, ["mountain"], "cents"), ["mountain"])
    df = units.withColumn("celsius", scalars.linear(F.col("cents"), thresholds.SCALE, thresholds.OFFSET))
    return thresholds.cold_zone(df, limits, ["mountain"], "celsius").select("row_idx", "col_idx", "mountain", "cold")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS mountain_key, 1 AS valid, round((n_nationkey / 10.0 + 273.15) / 0.1, 6)::DOUBLE AS threshold_raw, (n_nationkey / 10.0)::DOUBLE AS threshold_c, -1.0::DOUBLE AS samples, CAST(-1 AS BIGINT) AS buckets FROM nation")
def fixed_threshold(spark, sf_dir):
    got = thresholds.fixed(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("mountain_key"), (F.col("n_nationkey") / 10).alias("threshold_c")))
    return got.withColumn("threshold_raw", F.round("threshold_raw", 6))


# components


def _reach(where: str) -> str:
    return f"""WITH RECURSIVE {LAT}, {NEAR}, f AS (SELECT id, r, c, z FROM lat WHERE {where}), e AS (SELECT a.id AS u, b.id AS v FROM (SELECT f.*, dr, dc FROM f, n8) a JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc),
  reach(a, b) AS (SELECT id, id FROM f UNION SELECT a, e.v FROM reach JOIN e ON e.u = b)"""


@query(_reach("v > 6000") + " SELECT f.r AS row_idx, f.c AS col_idx, min(b) AS component, least(count(*), 500) AS capped FROM reach JOIN f ON f.id = a GROUP BY f.r, f.c")
def component_count(spark, sf_dir):
    df = lattice(spark, sf_dir).withColumn("f", F.when(F.col("v") > 6000, 1)).select("row_idx", "col_idx", "f")
    return components.sizes(components.label(df, "f", WIDTH, block=64)).select("row_idx", "col_idx", "component", F.least("n", F.lit(components.MAX_SIZE)).alias("capped"))


@query(_reach("v <= 2000") + " SELECT min(b) AS component, count(*) AS n, CAST(sum(g.z) AS BIGINT) AS z FROM (SELECT a, min(b) AS m FROM reach GROUP BY a) x JOIN f g ON g.id = x.a JOIN (SELECT DISTINCT m AS b FROM (SELECT a, min(b) AS m FROM reach GROUP BY a) q) y ON y.b = x.m GROUP BY x.m")
def component_area(spark, sf_dir):
    df = lattice(spark, sf_dir).withColumn("f", F.when(F.col("v") <= 2000, 1)).select("row_idx", "col_idx", "f", "z")
    return components.label(df, "f", WIDTH, block=64).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z"))


AREA = "pow(6371008.8 * 0.017453292519943295 * 0.00025, 2) * cos(radians(90 - (r + 360000 + 0.5) * 0.00025))"


def _hops(name: str, source: str) -> str:
    """Whether each cell's component has at least seven cells: as many lie within six steps."""
    return f"""{name}1 AS (SELECT a.id AS a, b.id AS b FROM (SELECT s.*, dr, dc FROM {source} s, n8) a JOIN {source} b ON b.r = a.r + dr AND b.c = a.c + dc AND b.k = a.k),
  {name}2 AS (SELECT DISTINCT x.a, y.b FROM {name}1 x JOIN {name}1 y ON x.b = y.a), {name}4 AS (SELECT DISTINCT x.a, y.b FROM {name}2 x JOIN {name}2 y ON x.b = y.a),
  {name}6 AS (SELECT x.a, count(DISTINCT y.b) AS n FROM {name}4 x JOIN {name}2 y ON x.b = y.a GROUP BY x.a)"""


@query(f"""WITH {LAT}, {NEAR}, f AS (SELECT id, r, c, CAST(v > 6000 AS INT) AS k FROM lat WHERE v IS NOT NULL), {_hops('p', 'f')},
  filled AS (SELECT f.id, r, c, 1 AS k FROM f JOIN p6 ON p6.a = f.id WHERE k + CAST(least(n, 500) * {AREA} <= 5000 AS INT) >= 1), {_hops('q', 'filled')},
  keep AS (SELECT f.id FROM filled f JOIN q6 ON q6.a = f.id WHERE least(n, 500) * {AREA} >= 5000)
  SELECT r AS row_idx, c AS col_idx, CASE WHEN v IS NOT NULL THEN CAST(id IN (SELECT id FROM keep) AS INT) END AS clean FROM lat""")
def mmu_sequence(spark, sf_dir):
    df = forest(lattice(spark, sf_dir)).select("row_idx", "col_idx", "forest")
    return components.mmu_sequence(df, "forest", FINE.area(F.col("row_idx") + ROW0), WIDTH, block=64).select("row_idx", "col_idx", "clean")


@query(f"""WITH {LAT}, {NEAR}, f AS (SELECT id, r, c, 1 AS k FROM lat WHERE v > 6000), {_hops('p', 'f')}, kept AS (SELECT l.id, l.r, l.c, CAST(coalesce(n, 0) >= 7 AS INT) AS k FROM lat l LEFT JOIN p6 ON p6.a = l.id),
  gap AS (SELECT id, r, c, 1 AS k FROM kept WHERE k = 0), {_hops('q', 'gap')} SELECT kept.r AS row_idx, kept.c AS col_idx, CASE WHEN kept.k = 1 OR n < 7 THEN 1 ELSE 0 END AS clean FROM kept LEFT JOIN q6 ON q6.a = kept.id""")
def mmu_legacy(spark, sf_dir):
    df = forest(lattice(spark, sf_dir)).select("row_idx", "col_idx", "forest")
    return components.mmu_legacy(df, "forest", FINE.area(F.col("row_idx") + ROW0), WIDTH, block=64).select("row_idx", "col_idx", "clean")


# products


@query(f"""WITH {LAT} SELECT r // 2 AS row_idx, c AS col_idx, arg_max(v, user_id * 1000000 + id) FILTER (WHERE v IS NOT NULL) AS v, arg_max(z, user_id * 1000000 + id) AS z FROM lat GROUP BY ALL""")
def mosaic(spark, sf_dir):
    df = lattice(spark, sf_dir).withColumn("rank", F.col("user_id") * 1_000_000 + F.col("row_idx") * WIDTH + F.col("col_idx")).withColumn("row_idx", F.floor(F.col("row_idx") / 2))
    return products.mosaic(df, ["v", "z"], "rank")


@query(f"WITH {LAT} SELECT r // 2 AS row_idx, c AS col_idx, max(v) AS v FROM lat GROUP BY ALL")
def collection_max(spark, sf_dir):
    return products.collection_max(lattice(spark, sf_dir).withColumn("row_idx", F.floor(F.col("row_idx") / 2)), ["v"])


@query(f"""WITH {LAT}, l1 AS (SELECT r // 2 AS r, c // 2 AS c, avg(cents) AS m FROM lat GROUP BY ALL), k1 AS (SELECT r // 2 AS r, c // 2 AS c, user_id % 3 AS k, count(*) AS n FROM lat GROUP BY ALL), mode1 AS (SELECT r, c, arg_max(k, n * 10 - k) AS k FROM k1 GROUP BY r, c),
  l2 AS (SELECT r // 2 AS r, c // 2 AS c, avg(m) AS m FROM l1 GROUP BY ALL), k2 AS (SELECT r // 2 AS r, c // 2 AS c, k, count(*) AS n FROM mode1 GROUP BY ALL), mode2 AS (SELECT r, c, arg_max(k, n * 10 - k) AS k FROM k2 GROUP BY r, c)
  SELECT r AS row_idx, c AS col_idx, round(m, 6) AS cents, k AS user_class FROM l2 JOIN mode2 USING (r, c)""")
def pyramid(spark, sf_dir):
    df = lattice(spark, sf_dir).select("row_idx", "col_idx", F.col("cents").cast("double").alias("cents"), (F.col("user_id") % 3).alias("user_class"))
    return products.pyramid(df, ["cents"], ["user_class"], level=2).withColumn("cents", F.round("cents", 6))


@query(f"WITH {LAT} SELECT r AS row_idx, c AS col_idx, CASE WHEN user_id % 4 <> 1 THEN z END AS elevation, CASE WHEN user_id % 4 = 0 THEN z END AS strict FROM lat")
def dem_prepare(spark, sf_dir):
    df = lattice(spark, sf_dir).withColumn("msk", F.col("user_id") % 4)
    loose = products.dem(df, "z", "msk")
    return products.dem(loose.withColumnRenamed("elevation", "loose"), "z", "msk", strict=True).select("row_idx", "col_idx", F.col("loose").alias("elevation"), F.col("elevation").alias("strict"))


CASCADE = WINDOW.replace("CASE WHEN v % 3 = 0 THEN 1 END AS cand", "CASE WHEN (SELECT 1) = 1 AND e.e = 1 AND user_id % 10 <> 0 AND user_id % 50 NOT IN (41, 42) THEN 1 END AS cand").replace(f"{LAT}, a AS (", f"{MEDIAN}, a AS (").replace("AS cand FROM lat),", "AS cand FROM lat JOIN zero e USING (r, c)),").replace("SELECT r, c, CAST(v > 6000 AS INT) AS forest, z", "SELECT r, c, CAST(v > 6000 AS INT) AS forest, z")


@query(f"""WITH {CASCADE} SELECT r AS row_idx, c AS col_idx, cand AS post_landform, CASE WHEN coalesce(cand = 1 AND nf >= 5 AND nn >= 5 AND se > 0 AND diff >= 0 AND (mf - mn) / nullif(se, 0) < {_critical(tests.ONE_SIDED)}, false) THEN z END AS treeline FROM test JOIN (SELECT r, c, z FROM lat) l USING (r, c)""")
def candidate_cascade(spark, sf_dir):
    df = forest(lattice(spark, sf_dir)).withColumns({"edge": F.col("v"), "domain": (F.col("user_id") % 10 != 0).cast("int"), "nonvalley": masks.invert(masks.class_mask(F.col("user_id") % 50, products.VALLEY_CLASSES))})
    edges = stencil.forest_edges(df.withColumn("edge", F.col("forest")), ["edge"])
    got = products.upper_edges(products.candidates(edges, "edge", "domain", "nonvalley"), "forest", "z", "post_landform", "domain")
    return products.treeline(got, "z").select("row_idx", "col_idx", "post_landform", "treeline")


def _qa_sql() -> str:
    out = []
    for j, b in enumerate(products.product_bands()["qa30m"]):
        own = f"CASE WHEN cents % {j + 2} <> 0 THEN cents + {j} END"
        filled = {"dem_msk": 255, "dem_stk": 0, "analysis_domain": 0, "gmba_mask": 0, "non_valley": 0}
        flag = b in filled or b.startswith(("forest_clean_", "candidate_edge_", "edge_post_landform_", "upper_", "cold_zone_"))
        out.append(f"{f'coalesce({own}, {filled.get(b, 0)})' if flag else own} AS {b}")
    return f"WITH {LAT} SELECT r AS row_idx, c AS col_idx, {', '.join(out)} FROM lat"


@query(_qa_sql())
def qa_stack(spark, sf_dir):
    c = F.col("cents")
    own = {b: F.when(c % (j + 2) != 0, c + j) for j, b in enumerate(products.product_bands()["qa30m"])}
    return products.qa_stack(lattice(spark, sf_dir).withColumns(own), ["row_idx", "col_idx"])


# mountains and tiles


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS mountain_key, CAST(c_custkey AS DOUBLE) AS sort_key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal / 10000 >= 0.5 AND c_nationkey / 25.0 <= 0.9""")
def mountain_select(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"hm_fraction": F.col("c_acctbal") / 10000, "tree_fraction": F.col("c_nationkey") / 25})
    return products.select_mountains(c, "c_custkey", unit="c_mktsegment", kind="BUILDING").select("c_custkey", "mountain_key", "sort_key")


@query("""SELECT count(*) AS n_rows, count(CASE WHEN c_name IS NOT NULL AND c_acctbal IS NOT NULL THEN 1 END) AS complete_rows, count(DISTINCT c_custkey) AS distinct_ids, count(CASE WHEN c_acctbal / 10000 < 0.5 THEN 1 END) AS below_hm, count(CASE WHEN c_nationkey / 25.0 > 0.9 THEN 1 END) AS above_tree,
  min(c_acctbal / 10000) AS least_hm, max(c_acctbal / 10000) AS largest_hm, count(DISTINCT c_mktsegment) AS units FROM customer""")
def table_validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"hm": F.col("c_acctbal") / 10000, "tree": F.col("c_nationkey") / 25})
    return control.table_facts(c, "c_custkey", ["c_name", "c_acctbal"], "hm", "tree", "c_mktsegment")


@query("""SELECT n_nationkey, n_name, s_name, s_acctbal FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) s ON s_nationkey = n_nationkey AND k = 1""")
def keep_first_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name", "s_acctbal")
    return products.keep_first(table(spark, sf_dir, "nation"), s, "n_nationkey", F.col("s_suppkey")).select("n_nationkey", "n_name", "s_name", "s_acctbal")


BOXES = """box AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 340) - 175.5 AS min_lon, (s_suppkey * 37 % 340) - 175.5 + 0.5 + s_suppkey % 7 AS max_lon, (s_suppkey * 53 % 150) - 78.5 AS min_lat, (s_suppkey * 53 % 150) - 78.5 + 0.25 + s_suppkey % 5 AS max_lat, s_acctbal AS area FROM supplier),
  tile AS (SELECT concat(CASE WHEN y >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs(y) AS VARCHAR), 2, '0'), '_', CASE WHEN x >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(x) AS VARCHAR), 3, '0')) AS tile_id, x AS x0, x + 10 AS x1, y AS y0, y + 10 AS y1 FROM (SELECT unnest(range(-90, 90, 10)) AS y) a, (SELECT unnest(range(-180, 180, 10)) AS x) b),
  hit AS (SELECT tile_id, id FROM tile JOIN box ON x0 <= max_lon AND x1 >= min_lon AND y0 <= max_lat AND y1 >= min_lat)"""


def _boxes(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    x, y = F.col("s_suppkey") * 37 % 340 - 175.5, F.col("s_suppkey") * 53 % 150 - 78.5
    return s.select(F.col("s_suppkey").alias("id"), x.alias("min_lon"), (x + 0.5 + F.col("s_suppkey") % 7).alias("max_lon"), y.alias("min_lat"), (y + 0.25 + F.col("s_suppkey") % 5).alias("max_lat"), F.col("s_acctbal").alias("area"))


@query(f"WITH {BOXES} SELECT DISTINCT tile_id FROM hit")
def tile_semi_join(spark, sf_dir):
    return vector.touched(vector.regular_tiles(spark, -90, 90), _boxes(spark, sf_dir)).select("tile_id")


@query(f"""WITH {BOXES}, n AS (SELECT id, count(tile_id) AS required_tiles FROM hit GROUP BY id), a AS (SELECT *, pow(6371008.8, 2) / 1e6 * radians(max_lon - min_lon) * (sin(radians(max_lat)) - sin(radians(min_lat))) AS bounds FROM box)
  SELECT a.id, coalesce(required_tiles, 0) AS required_tiles, round(bounds, 4) AS bounds_area_km2, round(CASE WHEN area > 0 THEN bounds / area END, 6) AS bounds_ratio FROM a LEFT JOIN n USING (id)""")
def geometry_metrics(spark, sf_dir):
    got = vector.geometry_metrics(_boxes(spark, sf_dir), vector.regular_tiles(spark, -90, 90), "area")
    return got.select("id", "required_tiles", F.round("bounds_area_km2", 4).alias("bounds_area_km2"), F.round("bounds_ratio", 6).alias("bounds_ratio"))


@query(f"""WITH {BOXES}, o AS (SELECT * FROM box WHERE max_lat > 60 OR min_lat < -60) SELECT count(*) AS outside, count(CASE WHEN id % 3 = 0 THEN 1 END) AS outside_listed, (SELECT count(DISTINCT tile_id) FROM hit JOIN tile USING (tile_id) JOIN o USING (id) WHERE y1 > 60 OR y0 < -60) AS outside_tiles,
  count(CASE WHEN id % 3 = 0 THEN 1 END) > 0 OR (SELECT count(DISTINCT tile_id) FROM hit JOIN tile USING (tile_id) JOIN o USING (id) WHERE y1 > 60 OR y0 < -60) > 0 AS requires_extension FROM o""")
def latitude_diagnostics(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return vector.latitude_diagnostics(boxes, vector.regular_tiles(spark, -90, 90), -60, 60, boxes.where("id % 3 = 0"))


@query("""WITH c AS (SELECT event_id // 100 AS r, event_id % 100 AS c, event_id % 100 * 1.0 + 0.5 AS x, event_id // 100 + 0.5 AS y FROM events),
  p(id, n, x1, y1, x2, y2, x3, y3) AS (SELECT n_nationkey, 0, n_nationkey * 4.0, n_nationkey * 2.0 + 0.25, n_nationkey * 4.0 + 9, n_nationkey * 2.0 + 1.25, n_nationkey * 4.0 + 3, n_nationkey * 2.0 + 8.25 FROM nation)
  SELECT r AS row_idx, c AS col_idx, id AS polygon_id FROM c JOIN p ON (CAST((y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS INT) + CAST((y2 > y) <> (y3 > y) AND x < x2 + (y - y2) * (x3 - x2) / (y3 - y2) AS INT) + CAST((y3 > y) <> (y1 > y) AND x < x3 + (y - y3) * (x1 - x3) / (y1 - y3) AS INT)) % 2 = 1""")
def rasterize(spark, sf_dir):
    # a grid of unit cells whose corner is at (0, 0), rows upwards
    class Plane:
        @staticmethod
        def longitude(col):
            return col + 0.5

        @staticmethod
        def latitude(row):
            return row + 0.5

    k = F.col("n_nationkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(point(k * 4, k * 2 + 0.25), point(k * 4 + 9, k * 2 + 1.25), point(k * 4 + 3, k * 2 + 8.25))
    polygons = table(spark, sf_dir, "nation").select(k.alias("id"), F.array(ring).alias("rings"))
    return vector.rasterized(lattice(spark, sf_dir).select("row_idx", "col_idx"), polygons, Plane)


# comparison

PAIR = f"""{LAT}, o AS (SELECT r, c, v AS a, CASE WHEN p % 5 <> 0 THEN p END AS b FROM lat WHERE id % 11 <> 0), n AS (SELECT r, c, CASE WHEN v > 500 THEN v + 3 END AS a, CASE WHEN p % 7 <> 0 THEN p - 2 * (id % 4) END AS b FROM lat WHERE id % 13 <> 0),
  j AS (SELECT o.a AS oa, o.b AS ob, n.a AS na, n.b AS nb FROM o FULL JOIN n USING (r, c))"""


def _pair(spark, sf_dir):
    df = lattice(spark, sf_dir).withColumn("id", F.col("row_idx") * WIDTH + F.col("col_idx"))
    old = df.where("id % 11 <> 0").select("row_idx", "col_idx", F.col("v").alias("a"), F.when(F.col("p") % 5 != 0, F.col("p")).alias("b"))
    new = df.where("id % 13 <> 0").select("row_idx", "col_idx", F.when(F.col("v") > 500, F.col("v") + 3).alias("a"), F.when(F.col("p") % 7 != 0, F.col("p") - 2 * (F.col("id") % 4)).alias("b"))
    return old, new


@query(f"""WITH {PAIR}, l AS (SELECT 'a' AS band, oa AS o, na AS n FROM j UNION ALL SELECT 'b', ob, nb FROM j) SELECT band, count(o) AS old_valid, count(n) AS new_valid, count(n - o) AS both_valid, count(CASE WHEN (o IS NULL) <> (n IS NULL) THEN 1 END) AS mask_mismatch, round(avg(n - o), 6) AS mean_difference, max(abs(n - o))::DOUBLE AS max_difference FROM l GROUP BY band""")
def compare_pairwise(spark, sf_dir):
    return compare.pairwise(*_pair(spark, sf_dir), ["a", "b"], ["row_idx", "col_idx"]).withColumn("mean_difference", F.round("mean_difference", 6))


@query(f"""WITH {PAIR}, m AS (SELECT *, oa IS NOT NULL AND ob IS NOT NULL AS o, na IS NOT NULL AND nb IS NOT NULL AS n FROM j) SELECT count(CASE WHEN o THEN 1 END) AS old_cells, count(CASE WHEN n THEN 1 END) AS new_cells, count(CASE WHEN o AND n THEN 1 END) AS both_cells, round(avg(CASE WHEN o AND n THEN na - oa END), 6) AS a_mean_difference, round(avg(CASE WHEN o AND n THEN nb - ob END), 6) AS b_mean_difference,
  max(CASE WHEN o AND n THEN abs(na - oa) END)::DOUBLE AS a_max_difference, max(CASE WHEN o AND n THEN abs(nb - ob) END)::DOUBLE AS b_max_difference FROM m""")
def compare_complete(spark, sf_dir):
    got = compare.complete_case(*_pair(spark, sf_dir), ["a", "b"], ["row_idx", "col_idx"])
    return got.withColumns({c: F.round(c, 6) for c in ("a_mean_difference", "b_mean_difference")})


@query(f"""WITH {LAT}, m AS (SELECT r, c, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256(concat_ws('|', r, c, 17)), r, c) AS k FROM lat) SELECT r AS row_idx, c AS col_idx, event_type FROM m WHERE k <= 3""")
def stratified_sample(spark, sf_dir):
    return compare.stratified(lattice(spark, sf_dir), "event_type", ["row_idx", "col_idx"], 3, 17).select("row_idx", "col_idx", "event_type")


@query(f"""WITH {LAT}, b AS (SELECT r, c, {BANDS4} FROM lat), e AS (SELECT *, unnest(range(CAST(floor(r * 0.03) AS BIGINT), CAST(floor(r * 0.03 + 0.0299999) AS BIGINT) + 1)) AS kr FROM b), g AS (SELECT *, unnest(range(CAST(floor(c * 0.03) AS BIGINT), CAST(floor(c * 0.03 + 0.0299999) AS BIGINT) + 1)) AS kc FROM e),
  h AS (SELECT *, (least(r * 0.03 + 0.03, kr + 1) - greatest(r * 0.03, kr)) * (least(c * 0.03 + 0.03, kc + 1) - greatest(c * 0.03, kc)) AS w FROM g),
  m AS (SELECT kr, kc, sum(treeline_2000_h3m_m * w) / nullif(sum(CASE WHEN treeline_2000_h3m_m IS NOT NULL THEN w END), 0) AS x, sum(treeline_2020_h3m_m * w) / nullif(sum(CASE WHEN treeline_2020_h3m_m IS NOT NULL THEN w END), 0) AS y FROM h GROUP BY kr, kc)
  SELECT 'treeline_2000_h3m_m' AS band, 0.001::DOUBLE AS tolerance, count(x) AS cells, 0.0::DOUBLE AS largest, max(abs(x - x)) <= 0.001 AS passes FROM m UNION ALL
  SELECT 'treeline_2020_h3m_m', 0.001::DOUBLE, count(y), round(max(abs(CASE WHEN kr % 2 = 0 THEN 0.5 ELSE 0 END)), 3)::DOUBLE, max(CASE WHEN kr % 2 = 0 THEN 0.5 ELSE 0 END) <= 0.001 FROM m WHERE y IS NOT NULL""")
def sample_check(spark, sf_dir):
    """The engine's means against sums over overlaps in climate cells' own units; an error planted in every second row of one band must fail."""
    df = _bands4(lattice(spark, sf_dir))
    bands = ["treeline_2000_h3m_m", "treeline_2020_h3m_m"]
    means = regrid.mean(df, bands).withColumn(bands[1], F.col(bands[1]) + F.when(F.col("crow") % 2 == 0, 0.5).otherwise(0.0))
    low, high = lambda c: F.floor(F.col(c) * 0.03), lambda c: F.floor(F.col(c) * 0.03 + 0.0299999)
    cut = df.withColumn("crow", F.explode(F.sequence(low("row_idx"), high("row_idx")))).withColumn("ccol", F.explode(F.sequence(low("col_idx"), high("col_idx"))))
    along = lambda c, k: F.least(F.col(c) * 0.03 + 0.03, F.col(k) + 1) - F.greatest(F.col(c) * 0.03, F.col(k))
    cut = cut.withColumn("w", along("row_idx", "crow") * along("col_idx", "ccol"))
    again = cut.groupBy("crow", "ccol").agg(*(F.try_divide(F.sum(F.col(b) * F.col("w")), F.sum(F.when(F.col(b).isNotNull(), F.col("w")))).alias(b) for b in bands))
    return compare.within(means, again, dict.fromkeys(bands, 1e-3), ["crow", "ccol"]).withColumn("largest", F.round("largest", 3))


# control plane

REG = """reg AS (SELECT CAST(o_custkey AS VARCHAR) AS mountain_id, CASE o_orderkey % 3 WHEN 0 THEN 'treeline30m' WHEN 1 THEN 'treeline1km' ELSE 'qa30m' END AS product, CONCAT('t', o_orderkey) AS task_id,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'READY' END AS state, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS attempt_count, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'User Memory Limit exceeded' ELSE 'Internal error' END ELSE '' END AS error_message, o_orderkey FROM orders),
  live AS (SELECT task_id, CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS live_state, CAST(o_orderkey % 5 AS INT) AS live_attempt, CASE WHEN o_orderkey % 10 = 0 THEN 'Execution failed; out of memory.' ELSE '' END AS live_error FROM reg WHERE o_orderkey % 5 = 0),
  stat AS (SELECT mountain_id, product, r.task_id, coalesce(CASE WHEN l.task_id IS NOT NULL THEN live_state ELSE state END, 'UNKNOWN') AS task_state, coalesce(live_attempt, attempt_count) AS attempt_count, coalesce(nullif(live_error, ''), nullif(error_message, ''), '') AS error_message FROM reg r LEFT JOIN live l USING (task_id)),
  diag AS (SELECT *, contains(lower(error_message), 'out of memory') OR contains(lower(error_message), 'memory limit') AS oom, coalesce(max(CASE WHEN product = 'treeline30m' THEN task_state END) OVER (PARTITION BY mountain_id), 'MISSING') AS source_state FROM stat),
  cat AS (SELECT *, CASE WHEN task_state <> 'FAILED' THEN NULL WHEN product = 'treeline1km' AND oom THEN CASE WHEN source_state = 'COMPLETED' THEN 'treeline1km_oom_with_completed_treeline30m' ELSE 'treeline1km_oom_without_completed_treeline30m' END WHEN product = 'treeline30m' AND oom THEN 'treeline30m_oom' WHEN product = 'qa30m' AND oom THEN 'qa30m_oom' ELSE 'other_error' END AS failure_category FROM diag)"""


def _registry(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    reg = o.select(
        F.col("o_custkey").cast("string").alias("mountain_id"), F.get(F.array(*map(F.lit, control.PRODUCTS)), (k % 3).cast("int")).alias("product"), F.concat(F.lit("t"), k).alias("task_id"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "COMPLETED").otherwise("READY").alias("state"), F.when(k % 7 != 0, (k % 4).cast("int")).alias("attempt_count"),
        F.when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "User Memory Limit exceeded").otherwise("Internal error")).otherwise("").alias("error_message"),
    )
    live = o.where(k % 5 == 0).select(F.concat(F.lit("t"), k).alias("task_id"), F.when(k % 10 == 0, "FAILED").otherwise("COMPLETED").alias("live_state"), (k % 5).cast("int").alias("live_attempt"), F.when(k % 10 == 0, "Execution failed; out of memory.").otherwise("").alias("live_error"))
    return reg, live


@query(f"WITH {REG} SELECT mountain_id, product, task_id, task_state, attempt_count, error_message FROM stat")
def task_status(spark, sf_dir):
    return control.normalized(*_registry(spark, sf_dir)).select("mountain_id", "product", "task_id", "task_state", "attempt_count", "error_message")


@query(f"WITH {REG} SELECT mountain_id, product, task_id, task_state, source_state, failure_category, source_state = 'COMPLETED' AS eligible FROM cat")
def diagnosis(spark, sf_dir):
    return control.diagnosed(control.normalized(*_registry(spark, sf_dir))).select("mountain_id", "product", "task_id", "task_state", "source_state", "failure_category", "eligible")


@query(f"""WITH {REG}, every AS (SELECT unnest(['treeline1km_oom_with_completed_treeline30m', 'treeline1km_oom_without_completed_treeline30m', 'treeline30m_oom', 'qa30m_oom', 'other_error']) AS failure_category) SELECT failure_category, count(task_id) AS n FROM every LEFT JOIN cat USING (failure_category) GROUP BY failure_category""")
def failure_groups(spark, sf_dir):
    return control.failure_counts(control.diagnosed(control.normalized(*_registry(spark, sf_dir))))


@query(f"WITH {REG} SELECT mountain_id FROM stat GROUP BY mountain_id HAVING bool_or(product = 'treeline1km' AND task_state = 'FAILED' AND (contains(lower(error_message), 'out of memory') OR contains(lower(error_message), 'memory limit'))) AND bool_or(product = 'treeline30m' AND task_state = 'COMPLETED')")
def failed_only(spark, sf_dir):
    return control.failed_only(control.normalized(*_registry(spark, sf_dir)))


@query(f"""WITH {REG}, n AS (SELECT mountain_id, product, count(*) AS n FROM stat GROUP BY ALL) SELECT s.mountain_id, max(CASE WHEN product = 'treeline30m' THEN task_id END) AS treeline30m, max(CASE WHEN product = 'treeline1km' THEN task_id END) AS treeline1km, max(CASE WHEN product = 'qa30m' THEN task_id END) AS qa30m, (SELECT count(*) FROM n WHERE n.mountain_id = s.mountain_id AND n > 1) AS duplicates FROM stat s GROUP BY s.mountain_id""")
def registry_pivot(spark, sf_dir):
    return control.by_product(control.normalized(*_registry(spark, sf_dir)), F.col("task_id"))


GUARD = """m AS (SELECT CAST(c_custkey AS VARCHAR) AS mountain_id, unnest(['treeline30m', 'treeline1km', 'qa30m']) AS product FROM customer),
  plan AS (SELECT mountain_id, product, concat('root/', product, '/', product, '_', mountain_id) AS destination, concat(product, '_', mountain_id) AS description, 'hash-a' AS configuration_hash, 'PLANNED' AS state FROM m),
  asset AS (SELECT destination, CASE WHEN CAST(mountain_id AS BIGINT) % 10 = 0 THEN 'hash-b' WHEN CAST(mountain_id AS BIGINT) % 10 = 5 THEN NULL ELSE 'hash-a' END AS asset_hash FROM plan WHERE CAST(mountain_id AS BIGINT) % 5 = 0 OR product = 'qa30m' AND CAST(mountain_id AS BIGINT) % 4 = 0),
  task AS (SELECT description, CASE WHEN CAST(mountain_id AS BIGINT) % 2 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS task_state, concat('x', mountain_id) AS active_id FROM plan WHERE CAST(mountain_id AS BIGINT) % 3 = 0)"""


def _guard(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("mountain_id"))
    plan = control.planned(m, "root", "hash-a")
    k = F.col("mountain_id").cast("long")
    assets = plan.where((k % 5 == 0) | ((F.col("product") == "qa30m") & (k % 4 == 0))).select("destination", F.when(k % 10 == 0, "hash-b").when(k % 10 == 5, None).otherwise("hash-a").alias("asset_hash"))
    tasks = plan.where(k % 3 == 0).select("description", F.when(k % 2 == 0, "RUNNING").otherwise("COMPLETED").alias("task_state"), F.concat(F.lit("x"), "mountain_id").alias("active_id"))
    return plan, assets, tasks


@query(f"WITH {GUARD} SELECT mountain_id, product, destination, description, configuration_hash, state FROM plan")
def planned_exports(spark, sf_dir):
    return _guard(spark, sf_dir)[0]


@query(f"""WITH {GUARD}, j AS (SELECT p.*, a.destination IS NOT NULL AS has_asset, asset_hash, t.active_id FROM plan p LEFT JOIN asset a USING (destination) LEFT JOIN (SELECT description, active_id FROM task WHERE task_state IN ('READY', 'RUNNING')) t USING (description)),
  k AS (SELECT *, CASE WHEN has_asset AND asset_hash IS DISTINCT FROM configuration_hash THEN 'different configuration' END AS conflict FROM j)
  SELECT mountain_id, product, destination, description, configuration_hash, CASE WHEN conflict IS NOT NULL THEN state WHEN has_asset THEN 'SKIPPED_EXISTING' WHEN active_id IS NOT NULL THEN 'SKIPPED_ACTIVE' ELSE state END AS state, conflict, CASE WHEN conflict IS NULL AND NOT has_asset THEN active_id END AS task_id FROM k""")
def resume_guard(spark, sf_dir):
    return control.resume_guarded(*_guard(spark, sf_dir), resume=True)


@query(f"""WITH {GUARD} SELECT (SELECT count(*) FROM task WHERE task_state = 'RUNNING') AS existing_ready, count(*) AS new_tasks, (SELECT count(*) FROM task WHERE task_state = 'RUNNING') + count(*) AS projected_ready, (SELECT count(*) FROM task WHERE task_state = 'RUNNING') + count(*) <= 3000 AS within_limit FROM plan""")
def queue_limit(spark, sf_dir):
    plan, _, tasks = _guard(spark, sf_dir)
    return control.queue_use(tasks.withColumn("task_state", F.when(F.col("task_state") == "RUNNING", "READY")), plan, 3000, "PLANNED")


@query(f"""WITH {GUARD}, a AS (SELECT description, concat(active_id, '-', k) AS active_id, k FROM task, (SELECT unnest([1, 2]) AS k) x) SELECT p.mountain_id, p.product, p.description, CASE WHEN CAST(mountain_id AS BIGINT) % 6 = 0 THEN 'own' ELSE (SELECT max(active_id) FROM a WHERE a.description = p.description AND k = 2) END AS task_id FROM plan p""")
def task_recovery(spark, sf_dir):
    plan, _, tasks = _guard(spark, sf_dir)
    seen = tasks.select("description", "active_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seen")).withColumn("active_id", F.concat_ws("-", "active_id", "seen"))
    own = plan.select("mountain_id", "product", "description", F.when(F.col("mountain_id").cast("long") % 6 == 0, "own").alias("task_id"))
    return control.recovered(own, seen).select("mountain_id", "product", "description", "task_id")


INV = """inv AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'h3m' ELSE 'h5m' END AS product, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat('T', p_partkey // 2 - CASE WHEN p_partkey % 89 = 0 THEN 1 ELSE 0 END) END AS tile_id, CASE WHEN p_partkey % 41 = 0 THEN ['tree_2020', 'tree_2000'] ELSE ['tree_2000', 'tree_2020'] END AS bands, CASE WHEN p_partkey % 43 = 0 THEN 'TABLE' ELSE 'IMAGE' END AS type,
  CASE WHEN p_partkey % 47 = 0 THEN 'none' ELSE CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_partkey % 53 = 0 THEN 50 ELSE 500 END AS max_size, CASE WHEN p_partkey % 59 = 0 THEN 4 WHEN p_partkey % 2 = 0 THEN 3 ELSE 5 END AS threshold, CASE WHEN p_partkey % 61 = 0 THEN '' WHEN p_partkey % 113 = 0 THEN 'h2' ELSE 'h1' END AS hash, CASE WHEN p_partkey % 67 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM part),
  named AS (SELECT * FROM inv WHERE tile_id IS NOT NULL), have AS (SELECT DISTINCT product, tile_id FROM named), expected AS (SELECT DISTINCT concat('T', p_partkey // 2 + CASE WHEN p_partkey % 101 = 0 THEN 1000000000 ELSE 0 END) AS tile_id FROM part)"""


@query(f"""WITH {INV} SELECT product, tile_id, 'invalid bands' AS error FROM named WHERE bands[1] <> 'tree_2000' UNION ALL SELECT product, tile_id, 'invalid type' FROM named WHERE type <> 'IMAGE' UNION ALL SELECT product, tile_id, 'empty asset' FROM named WHERE coalesce(TRY_CAST(size AS BIGINT), 0) <= 0
  UNION ALL SELECT product, tile_id, 'invalid max size' FROM named WHERE max_size <> 500 UNION ALL SELECT product, tile_id, 'wrong canopy threshold' FROM named WHERE threshold <> CASE product WHEN 'h3m' THEN 3 ELSE 5 END UNION ALL SELECT product, tile_id, 'missing configuration hash' FROM named WHERE hash = ''
  UNION ALL SELECT product, tile_id, 'failed tile' FROM named WHERE state = 'FAILED' UNION ALL SELECT product, tile_id, 'missing tile_id' FROM inv WHERE tile_id IS NULL UNION ALL SELECT product, tile_id, 'duplicate tile' FROM named GROUP BY product, tile_id HAVING count(*) > 1
  UNION ALL SELECT p, tile_id, 'missing tile' FROM (SELECT unnest(['h3m', 'h5m']) AS p, tile_id FROM expected) w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.product = p AND h.tile_id = w.tile_id)
  UNION ALL SELECT NULL, NULL, 'tile sets differ' WHERE EXISTS (SELECT tile_id FROM have GROUP BY tile_id HAVING count(*) < 2) UNION ALL SELECT NULL, NULL, 'mixed configuration hashes' WHERE (SELECT count(DISTINCT nullif(hash, '')) FROM named) <> 1""")
def inventory_errors(spark, sf_dir):
    k = F.col("p_partkey")
    bands = F.when(k % 41 == 0, F.array(F.lit("tree_2020"), F.lit("tree_2000"))).otherwise(F.array(F.lit("tree_2000"), F.lit("tree_2020")))
    inv = table(spark, sf_dir, "part").select(
        F.when(k % 2 == 0, "h3m").otherwise("h5m").alias("product"), F.when(k % 97 != 0, F.concat(F.lit("T"), F.expr("p_partkey div 2") - F.when(k % 89 == 0, 1).otherwise(0))).alias("tile_id"), bands.alias("bands"), F.when(k % 43 == 0, "TABLE").otherwise("IMAGE").alias("type"),
        F.when(k % 47 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("sizeBytes"), F.when(k % 53 == 0, 50).otherwise(500).alias("mmu_max_size"), F.when(k % 59 == 0, 4).when(k % 2 == 0, 3).otherwise(5).alias("canopy_threshold_m"),
        F.when(k % 61 == 0, "").when(k % 113 == 0, "h2").otherwise("h1").alias("configuration_hash"), F.lit("grid").alias("grid"), F.when(k % 67 == 0, "FAILED").otherwise("COMPLETED").alias("task_state"),
    )
    return control.inventory_errors(inv, table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.expr("p_partkey div 2") + F.when(k % 101 == 0, 1_000_000_000).otherwise(0)).alias("tile_id")).distinct())


# source assets, selection, full diagnosis

SRC = """k AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS mountain_id, c_acctbal FROM customer), p AS (SELECT *, unnest(['treeline30m', 'treeline1km', 'qa30m']) AS product FROM k),
  rec AS (SELECT k, mountain_id, product, concat('root/', product, '/gmba_', mountain_id, '_run_hash-abcde') AS destination, 'hash-abcdef0123' AS configuration_hash, concat('t', product, k) AS task_id, CAST(k % 3 AS INT) AS attempt_count,
    CASE WHEN product = 'treeline30m' AND k % 4 = 0 OR product = 'treeline1km' AND k % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS task_state, CASE WHEN product = 'treeline1km' AND k % 6 = 0 THEN 'Out of memory' ELSE '' END AS error_message FROM p WHERE NOT (product = 'treeline30m' AND k % 9 = 1)),
  src AS (SELECT *, k % 11 <> 0 AS there, CASE WHEN k % 11 = 0 THEN 'asset does not exist' WHEN k % 13 = 0 THEN 'not an image' WHEN k % 17 = 1 THEN 'invalid size' WHEN k % 17 = 0 THEN 'empty asset' WHEN k % 53 = 0 THEN 'identity differs' WHEN k % 59 = 0 THEN 'no band metadata' WHEN k % 19 = 0 THEN 'bands or their order differ'
    WHEN k % 23 = 0 THEN 'bands do not share a grid' WHEN k % 29 = 0 THEN 'mountain_id differs' WHEN k % 31 = 0 THEN 'configuration_hash differs' WHEN k % 37 = 0 THEN 'run_label is missing' WHEN k % 43 = 0 THEN 'git_commit is missing' WHEN k % 47 = 0 THEN 'workflow is missing' WHEN k % 41 = 0 THEN 'child name differs' END AS source_error
    FROM rec WHERE product = 'treeline30m'),
  able AS (SELECT r.mountain_id, coalesce(max(CASE WHEN r.product = 'treeline30m' THEN r.task_state END), 'MISSING') AS source_state, CASE WHEN max(s.k) IS NULL THEN 'no record' ELSE max(s.source_error) END AS source_error FROM rec r LEFT JOIN src s USING (mountain_id) GROUP BY r.mountain_id)"""


def _sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("mountain_id"))
    k, product = F.col("k"), F.col("product")
    rec = c.select("*", F.explode(F.array(*map(F.lit, control.PRODUCTS))).alias("product")).where(~((product == "treeline30m") & (k % 9 == 1)))
    failed = ((product == "treeline30m") & (k % 4 == 0)) | ((product == "treeline1km") & (k % 3 == 0))
    rec = rec.select(
        "k", "mountain_id", "product", F.concat(F.lit("root/"), "product", F.lit("/gmba_"), "mountain_id", F.lit("_run_hash-abcde")).alias("destination"), F.lit("hash-abcdef0123").alias("configuration_hash"), F.concat(F.lit("t"), "product", "k").alias("task_id"),
        (k % 3).cast("int").alias("attempt_count"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("task_state"), F.when((product == "treeline1km") & (k % 6 == 0), "Out of memory").otherwise("").alias("error_message"),
    )
    bands = products.product_bands()["treeline30m"]
    order = F.when(k % 59 != 0, F.when(k % 19 == 0, F.array(*map(F.lit, bands[::-1]))).otherwise(F.array(*map(F.lit, bands))))
    assets = rec.where((product == "treeline30m") & (k % 11 != 0)).select(
        "destination", F.when(k % 53 == 0, "other").otherwise(F.col("destination")).alias("asset_id"), F.when(k % 13 == 0, "TABLE").otherwise("IMAGE").alias("type"), F.when(k % 17 == 0, "0").when(k % 17 == 1, "none").otherwise("77").alias("size_bytes"),
        order.alias("band_ids"), F.when(k % 23 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a"))).alias("band_grids"), F.when(k % 29 == 0, "other").otherwise(F.col("mountain_id")).alias("p_mountain_id"),
        F.when(k % 31 != 0, F.col("configuration_hash")).alias("p_configuration_hash"), F.when(k % 37 == 0, "").when(k % 41 == 0, "walk").otherwise("run").alias("p_run_label"), F.when(k % 43 != 0, "c0ffee").alias("p_git_commit"), F.when(k % 47 != 0, "step 2").alias("p_workflow"),
    )
    return rec.drop("k"), validation.source_errors(rec.where(product == "treeline30m").select("mountain_id", "destination", "configuration_hash"), assets)


@query(f"WITH {SRC} SELECT mountain_id, destination, there AS source_exists, source_error FROM src")
def source_validation(spark, sf_dir):
    return _sources(spark, sf_dir)[1].select("mountain_id", "destination", "source_exists", "source_error")


@query(f"WITH {SRC} SELECT mountain_id, CAST(NULL AS VARCHAR) AS reason FROM able WHERE source_state = 'COMPLETED' AND source_error IS NULL")
def select_all(spark, sf_dir):
    return validation.selected(*_sources(spark, sf_dir))


@query(f"WITH {SRC} SELECT mountain_id, CAST(NULL AS VARCHAR) AS reason FROM able WHERE source_state = 'COMPLETED' AND source_error IS NULL AND CAST(mountain_id AS BIGINT) % 6 = 0")
def select_failed(spark, sf_dir):
    return validation.selected(*_sources(spark, sf_dir), mode="failed")


@query(f"""WITH {SRC}, want AS (SELECT DISTINCT CAST(s_suppkey * 7 AS VARCHAR) AS mountain_id FROM supplier) SELECT mountain_id, CASE WHEN source_state IS NULL THEN 'absent from the registry' WHEN source_state <> 'COMPLETED' THEN 'source is not completed' ELSE source_error END AS reason FROM want LEFT JOIN able USING (mountain_id)""")
def select_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).cast("string").alias("mountain_id"))
    return validation.selected(*_sources(spark, sf_dir), mode="ids", ids=ids)


@query(f"""WITH {SRC}, ex AS (SELECT destination FROM rec WHERE k % 5 <> 0) SELECT r.mountain_id, r.product, task_id, r.task_state, attempt_count, error_message, r.destination, r.k % 5 <> 0 AS destination_exists,
  coalesce(s.destination, '') AS source_treeline30m_asset, coalesce(s.there, false) AS source_treeline30m_exists, source_state AS source_treeline30m_task_state, s.k IS NOT NULL AND s.source_error IS NULL AS source_treeline30m_valid, coalesce(s.source_error, '') AS source_treeline30m_validation_error,
  r.k % 5 <> 0 AS source_qa30m_exists, round(c_acctbal, 2) AS gmba_area_km2, round(2 * c_acctbal, 2) AS bounds_area_km2, 2.0::DOUBLE AS bounds_to_gmba_area_ratio, r.k % 7 AS required_step1_tile_count, source_state = 'COMPLETED' AND s.k IS NOT NULL AND s.source_error IS NULL AS eligible_for_materialized_1km,
  CASE WHEN r.task_state <> 'FAILED' THEN NULL WHEN r.product = 'treeline1km' AND error_message <> '' THEN CASE WHEN source_state = 'COMPLETED' THEN 'treeline1km_oom_with_completed_treeline30m' ELSE 'treeline1km_oom_without_completed_treeline30m' END ELSE 'other_error' END AS failure_category
  FROM rec r JOIN able USING (mountain_id) JOIN k USING (mountain_id) LEFT JOIN (SELECT mountain_id, k, destination, there, source_error FROM src) s USING (mountain_id)""")
def diagnostic_rows(spark, sf_dir):
    rec, errors = _sources(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    area = F.round("c_acctbal", 2)
    metrics = c.select(F.col("c_custkey").cast("string").alias("mountain_id"), area.alias("gmba_area_km2"), F.round(2 * F.col("c_acctbal"), 2).alias("bounds_area_km2"), F.lit(2.0).alias("bounds_to_gmba_area_ratio"), (F.col("c_custkey") % 7).alias("required_step1_tile_count"))
    return validation.diagnostic_rows(rec, rec.where(F.col("mountain_id").cast("long") % 5 != 0), errors, metrics)


@query("""SELECT concat('t', k) AS task_id, CASE WHEN k % 2 = 0 THEN CAST(k % 5 AS INT) ELSE CAST(k % 4 AS INT) END AS attempt_count, CASE k % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE '' END AS error_message FROM (SELECT o_orderkey AS k FROM orders) t""")
def registry_layouts(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.concat(F.lit("t"), F.col("o_orderkey"))
    old = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, n).when(k % 3 == 1, "").alias("task_id"), F.when(k % 3 == 1, n).alias("id"), F.when(k % 3 == 2, n).otherwise("other").alias("name"), F.when(k % 2 == 0, (k % 5).cast("int")).alias("attempt_count"), (k % 4).cast("int").alias("attempt"),
        F.when(k % 3 == 0, "new").otherwise("").alias("error_message"), F.when(k % 3 == 2, None).otherwise("old").alias("error"),
    )
    return validation.coalesced(old)


@query("""WITH inv AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'h3m' ELSE 'h5m' END AS product, concat('T', s_suppkey // 2 % 50) AS tile_id FROM supplier), req AS (SELECT DISTINCT concat('T', c_nationkey * 3) AS tile_id FROM customer), pair AS (SELECT tile_id FROM inv GROUP BY tile_id HAVING count(*) = 2),
  miss AS (SELECT tile_id FROM req WHERE tile_id NOT IN (SELECT tile_id FROM pair)) SELECT (SELECT count(*) FROM inv WHERE tile_id = 'T7') AS n_errors, (SELECT count(*) FROM req) AS required_tiles, (SELECT coalesce(list(tile_id ORDER BY tile_id), []) FROM miss) AS missing_required_tile_ids, false AS ready""")
def step1_integrity(spark, sf_dir):
    s = F.col("s_suppkey")
    inv = table(spark, sf_dir, "supplier").select(F.when(s % 2 == 0, "h3m").otherwise("h5m").alias("product"), F.concat(F.lit("T"), F.expr("s_suppkey div 2 % 50")).alias("tile_id")).distinct()
    required = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_nationkey") * 3).alias("tile_id"))
    return validation.integrity(inv.where("tile_id = 'T7'"), inv, required)


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS up, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS down, count(*) OVER () AS n FROM customer)
  SELECT 'smallest' AS kind, c_custkey, c_acctbal FROM c WHERE up = 0 UNION ALL SELECT 'median', c_custkey, c_acctbal FROM c WHERE up = n // 2 UNION ALL SELECT 'largest', c_custkey, c_acctbal FROM c WHERE down = 1""")
def area_representatives(spark, sf_dir):
    return validation.by_area(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


@query("""SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) t WHERE k = n // 2""")
def representative(spark, sf_dir):
    return control.representative(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10 OFFSET 20")
def mountain_plan(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").orderBy("c_custkey").offset(20).limit(10)


@query("""WITH e AS (SELECT vec_id, embedding AS x FROM embeddings), s AS (SELECT vec_id, x, list_transform(range(1, 64), lambda i : list_sum(x[1:i]::DOUBLE[])) AS u, list_sum(x::DOUBLE[]) AS t FROM e), k AS (SELECT vec_id, x, list_transform(range(1, 64), lambda i : round(u[i] * u[i] / i + (t - u[i]) * (t - u[i]) / (64 - i), 9)) AS sc FROM s)
  SELECT vec_id, CAST(len(sc) - list_position(list_reverse(sc), list_max(sc)) + 1 AS INT) AS split, round(list_max(sc), 6) AS score FROM k""")
def vector_split(spark, sf_dir):
    # the split of an array with the largest between-class score: cumulative sums and arg-max over array functions
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    running = F.aggregate("x", F.array().cast("array<double>"), lambda a, v: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + v))
    s = e.select("vec_id", F.size("x").alias("n"), running.alias("r")).select("vec_id", "n", F.element_at("r", -1).alias("t"), F.slice("r", F.lit(1), F.col("n") - 1).alias("u"))
    score = F.transform("u", lambda u, i: F.struct(F.round(u * u / (i + 1) + (F.col("t") - u) * (F.col("t") - u) / (F.col("n") - i - 1), 9).alias("score"), (i + 1).alias("split")))
    best = s.select("vec_id", F.array_max(score).alias("b"))
    return best.select("vec_id", F.col("b.split").alias("split"), F.round("b.score", 6).alias("score"))


# set operations, orders, dates


@query("SELECT p_size AS id, min(p_partkey) AS first FROM part GROUP BY p_size")
def ordered_dedup(spark, sf_dir):
    return products.first_of_each(table(spark, sf_dir, "part").select(F.col("p_size").alias("id"), F.col("p_partkey").alias("first")), "id", "first")


@query("""SELECT n_nationkey AS id, n_name AS name, NULL AS balance, 'nation' AS source FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier""")
def tagged_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return products.tagged_union({"nation": n, "supplier": s}).select("id", "name", "balance", "source")


@query("""WITH e AS (SELECT DISTINCT c_nationkey + 5 AS k FROM customer), f AS (SELECT DISTINCT n_nationkey AS k FROM nation) SELECT k, 'missing' AS side FROM e WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, 'unexpected' FROM f WHERE k NOT IN (SELECT k FROM e)""")
def tile_set_difference(spark, sf_dir):
    return products.set_differences(table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 5).alias("k")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), "k")


@query("""SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id) AS place FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN concat('x', s_suppkey) ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier) t""")
def numeric_order(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("s_suppkey")
    ids = table(spark, sf_dir, "supplier").select(F.when(k % 4 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*scalars.numeric_order(F.col("id")))))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp FROM orders")
def compact_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.compact_utc(F.col("o_orderdate")).alias("stamp"))


def _bundle(spark, sf_dir) -> dict[str, DataFrame]:
    from ecotone.plans import bundle

    df = lattice(spark, sf_dir)
    v, p, u = F.col("v"), F.col("p"), F.col("user_id")
    # mountains are bands of rows; climate cells lie as coarse as the lattice is wide, so that each mountain has enough of them
    cells = df.select("row_idx", "col_idx", F.when(u % 10 != 0, (F.col("row_idx") / 40).cast("int")).alias("mountain_id"), (v > 6000).cast("int").alias("tree_2000_h3m"), (v > 5000).cast("int").alias("tree_2020_h3m"), (v > 8000).cast("int").alias("tree_2000_h5m"), (p > 30_000_000).cast("int").alias("tree_2020_h5m"), F.col("z").cast("int").alias("elevation"), (u % 50).alias("landform"), (u % 4).alias("dem_msk"), (u % 3).alias("dem_stk"), F.lit(0.75).alias("hm_fraction"), F.lit(0.25).alias("tree_fraction"))
    climate = regrid.overlaps(cells.select("row_idx", "col_idx")).select("crow", "ccol").distinct().withColumn("bio01_raw", (2750 + F.col("crow") * 7 + F.col("ccol") * 3).cast("int"))
    return bundle.mountain_bundle(cells, climate, samples=2)


@query()
def mountain_treeline30m(spark, sf_dir):
    return _bundle(spark, sf_dir)["treeline30m"]


@query()
def mountain_treeline1km(spark, sf_dir):
    return _bundle(spark, sf_dir)["treeline1km"]


@query()
def mountain_qa30m(spark, sf_dir):
    return _bundle(spark, sf_dir)["qa30m"]


@query()
def mountain_thresholds(spark, sf_dir):
    return _bundle(spark, sf_dir)["thresholds"]
