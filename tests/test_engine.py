"""The reference operators: fixed numbers, brute force, round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ecotone.functions import masks, scalars, tests
from ecotone.functions.grid import CLIMATE, FINE
from ecotone.operators import components, products, regrid, stencil, thresholds, vector
from ecotone.plans import control
from ecotone.sources import documents, raster


def lattice(spark, rows):
    """rows: a list of lists of values, None masked."""
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "row_idx long, col_idx long, x int")


def test_tile_counts(spark):
    assert vector.regular_tiles(spark).count() == 504
    assert vector.regular_tiles(spark, -90, 90).count() == 648
    first = vector.regular_tiles(spark).orderBy("min_lat", "min_lon").head()
    assert first["tile_id"] == "S60_W180"
    with pytest.raises(ValueError):
        vector.regular_tiles(spark, -65, 80)


def test_grid_index_round_trip():
    rows = FINE.index_range(10.0, 20.0, "row")
    assert rows[1] - rows[0] == 40_000
    cols = CLIMATE.index_range(0.0, 10.0, "col")
    assert cols == (21_600, 22_800)


def test_every_climate_cell_touches_34_fine_cells(spark):
    df = spark.range(0, 300).select(F.col("id").alias("row_idx"), F.lit(0).cast("long").alias("col_idx"))
    got = regrid.overlaps(df).groupBy("crow").agg(F.count(F.lit(1)).alias("n")).where("crow < 8").collect()
    assert {r["n"] for r in got} == {34}


def test_otsu_of_the_reference_histogram(spark):
    rows = [("m", 0, 10.0, 0.0), ("m", 1, 1.0, 1.0), ("m", 2, 1.0, 2.0), ("m", 3, 10.0, 3.0), ("few", 0, 3.0, 0.0), ("few", 1, 3.0, 1.0), ("one", 5, 50.0, 5.0)]
    b = spark.createDataFrame(rows, "mountain string, bucket int, n double, mean double")
    got = {r["mountain"]: r for r in thresholds.otsu(b, ["mountain"]).collect()}
    assert got["m"]["threshold_raw"] == 1.0 and got["m"]["valid"] == 1
    assert got["few"]["valid"] == 0 and got["few"]["threshold_raw"] is None
    assert got["one"]["valid"] == 0


def test_otsu_ties(spark):
    # an empty bucket between two occupied ones: equal scores on either side of it
    b = spark.createDataFrame([("m", 0, 10.0, 0.0), ("m", 1, 0.0, 1.0), ("m", 2, 10.0, 2.0)], "mountain string, bucket int, n double, mean double")
    assert thresholds.otsu(b, ["mountain"]).head()["threshold_raw"] == 1.0
    assert thresholds.otsu(b, ["mountain"], tie="first").head()["threshold_raw"] == 0.0


def test_linear_temperature(spark):
    assert spark.range(1).select(scalars.linear(F.lit(2756), 0.1, -273.15)).head()[0] == pytest.approx(2.45)


def test_histogram_width_is_a_power_of_two(spark):
    df = spark.range(1000).select(F.lit("m").alias("k"), F.col("id").alias("v"))
    got = thresholds.histogram(df, ["k"], "v").orderBy("bucket").collect()
    assert len(got) == 250 and got[1]["bucket"] == 4 and got[1]["n"] == 4 and got[1]["mean"] == 5.5


def test_median_edge_and_null(spark):
    df = lattice(spark, [[0, 0, 1, 1], [0, None, 1, 1], [0, 0, 1, None]])
    got = {(r["row_idx"], r["col_idx"]): r["x"] for r in stencil.focal_median(df, ["x"]).collect()}
    assert got[(0, 0)] == 0.0 and got[(0, 3)] == 1.0
    assert got[(0, 1)] == 0.0  # zeros at (0,0),(0,1),(1,0), ones at (0,2),(1,2)


def test_flat_patch_has_no_spread(spark):
    df = spark.range(121).select((F.col("id") / 11).cast("long").alias("row_idx"), (F.col("id") % 11).alias("col_idx"), F.lit(7).alias("z"), (F.col("id") % 2).cast("int").alias("forest"), F.lit(1).alias("domain"), F.lit(1).alias("cand"))
    got = products.upper_edges(df, "forest", "z", "cand", "domain")
    assert got.where("upper = 1").count() == 0
    assert got.where("t IS NOT NULL").count() == 0


def test_critical_values(spark):
    got = spark.createDataFrame([(0.5,), (1.0,), (11.9,), (12.0,), (5000.0,)], "df double").select(tests.critical_t(F.col("df"))).collect()
    assert [r[0] for r in got] == [-6.314, -6.314, -1.812, -1.782, -1.645]


@pytest.mark.parametrize("block", [3, 64])
def test_components_against_flood_fill(spark, block):
    rnd = random.Random(block)
    rows = [[rnd.choice([0, 1, 1, None]) for _ in range(17)] for _ in range(13)]
    got = {(r["row_idx"], r["col_idx"]): r["component"] for r in components.label(lattice(spark, rows), "x", 17, block=block).collect()}
    seen = {}
    for r in range(13):
        for c in range(17):
            if rows[r][c] is None or (r, c) in seen:
                continue
            todo, seen[(r, c)] = [(r, c)], r * 17 + c
            while todo:
                i, j = todo.pop()
                for a in (i - 1, i, i + 1):
                    for b in (j - 1, j, j + 1):
                        if 0 <= a < 13 and 0 <= b < 17 and (a, b) not in seen and rows[a][b] == rows[i][j]:
                            seen[(a, b)] = r * 17 + c
                            todo.append((a, b))
    assert got == seen


def test_checkerboard_is_two_components(spark):
    rows = [[(r + c) % 2 for c in range(8)] for r in range(8)]
    assert components.label(lattice(spark, rows), "x", 8, block=3).select("component").distinct().count() == 2


@pytest.mark.parametrize("cells,kept", [(6, 0), (7, 7)])
def test_mapping_unit_at_the_equator(spark, cells, kept):
    rows = [[1 if r == 5 and 2 <= c < 2 + cells else 0 for c in range(20)] for r in range(12)]
    got = components.mmu_sequence(lattice(spark, rows), "x", FINE.area(F.col("row_idx") + 360_000), 20)
    assert got.where("clean = 1").count() == kept


def test_overlap_means(spark):
    rows = [(0.000125, 0.000125, 0.0, 0.0), (0.000375, 0.000125, 10.0, None)]
    got = regrid.overlap_means(spark.createDataFrame(rows, "lon double, lat double, a double, b double"), ["a", "b"]).head()
    assert got["overlaps"] == 2 and got["a_weight"] == pytest.approx(1.2) and got["a"] == pytest.approx(10 / 6) and got["b_weight"] == pytest.approx(1.0) and got["b"] == 0.0
    four = spark.createDataFrame([(x, y, v) for (x, y), v in zip([(0.000125, 0.000125), (0.000375, 0.000125), (0.000125, 0.000375), (0.000375, 0.000375)], [1.0, 3.0, 5.0, 7.0])], "lon double, lat double, a double")
    got = regrid.overlap_means(four, ["a"], cell=(0.0, 0.0, 0.0005, 0.0005)).head()
    assert got["overlaps"] == 4 and got["a"] == pytest.approx(4.0)


def test_band_counts():
    bands = products.product_bands()
    assert [len(bands[k]) for k in ("treeline30m", "treeline1km", "qa30m")] == [4, 6, 45]
    assert bands["treeline30m"][0] == "treeline_2000_h3m_m" and bands["qa30m"][-1] == "otsu_valid_h5m"


def test_masks(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (None, None), (1, 1)], "a int, b int")
    got = df.select(masks.both(F.col("a"), F.col("b")), masks.self_mask(F.col("a")), masks.unmask(F.col("a"), 9)).collect()
    assert [tuple(r) for r in got] == [(0, None, 0), (None, 1, 1), (None, None, 9), (1, 1, 1)]
    assert spark.range(1).select(masks.above(F.lit(float("nan")), 3.0)).head()[0] is None


def test_failure_categories(spark):
    rows = [("treeline1km", "FAILED", "Execution failed; out of memory.", True), ("treeline1km", "FAILED", "User Memory Limit exceeded", False), ("treeline30m", "FAILED", "out of memory", True), ("qa30m", "FAILED", "out of memory", True), ("qa30m", "FAILED", None, True), ("qa30m", "COMPLETED", "out of memory", True)]
    df = spark.createDataFrame(rows, "p string, s string, m string, c boolean")
    got = [r[0] for r in df.select(scalars.failure_category(F.col("p"), F.col("s"), F.col("m"), F.col("c"))).collect()]
    assert got == [*scalars.FAILURE_CATEGORIES, None]


def test_settings_and_receipts():
    assert control.Settings().digest() == control.Settings().digest() != control.Settings(least_samples=6).digest()
    for bad in ({"queue_limit": 0}, {"canopy_thresholds": (3, 3)}, {"window_radius_m": 0}):
        with pytest.raises(ValueError):
            control.Settings(**bad)
    assert control.Settings().dry_run(None)["exports"] == 0
    identity = {"a": 1}
    receipt = {"upstream_identity": json.dumps(identity, sort_keys=True, separators=(",", ":")), "analysis_table": {"selected_feature_count": 3, "distinct_gmba_id_count": 3}, "step1_integrity": {"ready": True}, "deep_check": {"status": "PASSED"}}
    assert control.receipt_matches(receipt, identity) == []
    assert control.receipt_matches(receipt, {"a": 2}) == ["another upstream identity"]


def test_documents(spark, tmp_path):
    path = str(tmp_path / "tiles.json")
    tile = {"tile_id": "N00_E000", "bbox": [0.0, 0.0, 10.0, 10.0], "min_lon": 0.0, "max_lon": 10.0, "min_lat": 0.0, "max_lat": 10.0}
    documents.write_new_json(path, {"configuration_hash": "h", "tiles": [tile]})
    assert documents.read_manifest(spark, path).head()["tile_id"] == "N00_E000"
    with pytest.raises(FileExistsError):
        documents.write_new_json(path, {})
    twice = str(tmp_path / "twice.json")
    documents.write_json(twice, {"configuration_hash": "h", "tiles": [tile, tile]})
    with pytest.raises(ValueError):
        documents.read_manifest(spark, twice)
    assert documents.asset_exists(spark, path) and not documents.asset_exists(spark, path + ".none")
    assert "tiles.json" in documents.list_assets(spark, str(tmp_path))


def test_raster_round_trip(spark, tmp_path):
    df = lattice(spark, [[1, 2], [3, None]])
    raster.write_lattice(df, str(tmp_path / "x"), {"grid": "fine"})
    back = raster.read_lattice(spark, str(tmp_path / "x"), ["x"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert raster.read_metadata(spark, str(tmp_path / "x")) == {"grid": "fine"}
    assert sorted(map(tuple, raster.from_blocks(raster.to_blocks(df, ["x"])).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert raster.dense(df.where("x = 1"), (0, 3), (0, 3)).count() == 9


def test_monitor(spark, tmp_path):
    from ecotone.streaming import monitor

    (tmp_path / "a.json").write_text('{"task_id":"t1","description":"d","state":"READY","updated":"2024-01-01T00:00:00Z"}\n{"task_id":"t1","description":"d","state":"COMPLETED","updated":"2024-01-01T00:05:00Z"}\n')
    q = monitor.latest_states(monitor.status_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("latest_states").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest_states").collect()] == [("t1", "COMPLETED")]
