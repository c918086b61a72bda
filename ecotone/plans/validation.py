"""Source assets, selection, full diagnosis and integrity of the tiles, for all mountains in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecotone.functions.scalars import numeric_order, safe_name
from ecotone.operators.products import product_bands
from ecotone.plans.control import diagnosed, failed_only

#: Digits of the configuration hash in an asset's name.
HASH_DIGITS = 10


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty; empty if none is."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def coalesced(tasks: DataFrame) -> DataFrame:
    """Registry rows of older layouts as of the newest: task_id from task_id, id or name, attempt_count from it or attempt, error_message from it or error."""
    have = lambda *names: [F.col(c) for c in names if c in tasks.columns]
    old = [c for c in ("id", "name", "attempt", "error") if c in tasks.columns]
    none = F.lit(None)
    return tasks.withColumns({
        "task_id": first_text(*have("task_id", "id", "name"), F.lit("")),
        "attempt_count": F.coalesce(*have("attempt_count", "attempt"), none.cast("int")),
        "error_message": first_text(*have("error_message", "error"), F.lit("")),
    }).drop(*old)


def source_errors(records: DataFrame, assets: DataFrame, run_label: str | None = None) -> DataFrame:
    """records (mountain_id, destination, configuration_hash) with `source_exists` and `source_error`: the first rule that the 30 m asset breaks, null if none.

    assets: destination (the name asked for), asset_id (the name found), type,
    size_bytes (text), band_ids and band_grids (arrays), and the properties
    p_mountain_id, p_configuration_hash, p_run_label, p_git_commit, p_workflow.
    """
    got = records.join(assets.withColumn("source_exists", F.lit(True)), "destination", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    size = F.expr("try_cast(size_bytes AS BIGINT)")
    child = F.concat(F.lit("gmba_"), safe_name(F.col("mountain_id")), F.lit("_"), safe_name(F.col("p_run_label")), F.lit("_"), F.left("configuration_hash", F.lit(HASH_DIGITS)))
    rules = [
        ("asset does not exist", F.col("source_exists").isNull()),
        ("not an image", ~F.col("type").eqNullSafe(F.lit("IMAGE"))),
        ("invalid size", (text("size_bytes") != "") & size.isNull()),
        ("empty asset", F.coalesce(size, F.lit(0)) <= 0),
        ("identity differs", (text("destination") == "") | (text("asset_id") != F.col("destination"))),
        ("no band metadata", F.col("band_ids").isNull()),
        ("bands or their order differ", F.col("band_ids") != F.array(*map(F.lit, product_bands()["treeline30m"]))),
        ("bands do not share a grid", F.size(F.array_distinct("band_grids")) != 1),
        ("mountain_id differs", (text("mountain_id") == "") | (text("p_mountain_id") != F.col("mountain_id"))),
        ("configuration_hash differs", (text("configuration_hash") == "") | (text("p_configuration_hash") != F.col("configuration_hash"))),
        ("run_label is missing", text("p_run_label") == ""),
        ("run_label differs", F.lit(run_label is not None) & (F.col("p_run_label") != F.lit(run_label or ""))),
        ("git_commit is missing", text("p_git_commit") == ""),
        ("workflow is missing", text("p_workflow") == ""),
        ("child name differs", F.substring_index("destination", "/", -1) != F.coalesce(child, F.lit(""))),
    ]
    error = F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules))
    return got.select(*records.columns, F.coalesce("source_exists", F.lit(False)).alias("source_exists"), error.alias("source_error"))


def eligibility(status: DataFrame, sources: DataFrame) -> DataFrame:
    """(mountain_id, source_state, source_error, eligible) of every mountain: its source task is completed and its asset valid.

    status: normalized registry rows; sources: `source_errors` of the 30 m records.
    """
    state = status.groupBy("mountain_id").agg(F.coalesce(F.max(F.when(F.col("product") == "treeline30m", F.col("task_state"))), F.lit("MISSING")).alias("source_state"))
    got = state.join(sources.select("mountain_id", "source_error", F.lit(True).alias("_record")), "mountain_id", "left")
    error = F.when(F.col("_record").isNull(), F.lit("no record")).otherwise(F.col("source_error"))
    return got.select("mountain_id", "source_state", error.alias("source_error"), ((F.col("source_state") == "COMPLETED") & error.isNull()).alias("eligible"))


def selected(status: DataFrame, sources: DataFrame, mode: str = "all", ids: DataFrame | None = None) -> DataFrame:
    """(mountain_id, reason) in numeric order: reason is null for the mountains to run, else why one asked for cannot.

    mode: `all` mountains with a 30 m task, `failed` ones whose 1 km task ran
    out of memory after its source was completed, or `ids` (mountain_id).
    Only mountains asked for by id, and absent or ineligible, have a reason;
    in the other modes ineligible ones are left out.
    """
    able = eligibility(status, sources)
    if mode == "ids":
        got = ids.select("mountain_id").distinct().join(able, "mountain_id", "left")
        reason = F.when(F.col("source_state").isNull(), "absent from the registry").when(F.col("source_state") != "COMPLETED", "source is not completed").otherwise(F.col("source_error"))
        got = got.select("mountain_id", reason.alias("reason"))
    elif mode in ("all", "failed"):
        asked = failed_only(status) if mode == "failed" else status.where("product = 'treeline30m'").select("mountain_id").distinct()
        got = asked.join(able.where("eligible"), "mountain_id", "left_semi").select("mountain_id", F.lit(None).cast("string").alias("reason"))
    else:
        raise ValueError(f"no such mode: {mode}")
    return got.orderBy(*numeric_order(F.col("mountain_id")))


def diagnostic_rows(status: DataFrame, assets: DataFrame, sources: DataFrame, metrics: DataFrame) -> DataFrame:
    """The twenty columns of the full diagnosis, a row for each registry row.

    status: normalized rows with destination; assets: destination of each that
    exists; metrics: mountain_id with the three areas' columns and the number
    of required tiles.
    """
    exists = assets.select("destination").distinct().withColumn("destination_exists", F.lit(True))
    got = diagnosed(status).join(exists, "destination", "left")
    of = lambda p, c: F.max(F.when(F.col("product") == p, c))
    per = got.groupBy("mountain_id").agg(of("treeline30m", F.col("destination")).alias("source_treeline30m_asset"), F.coalesce(of("qa30m", F.col("destination_exists")), F.lit(False)).alias("source_qa30m_exists"))
    got = got.join(per, "mountain_id").join(sources.select("mountain_id", "source_exists", "source_error", F.lit(True).alias("_record")), "mountain_id", "left").join(metrics, "mountain_id", "left")
    valid = F.coalesce(F.col("_record") & F.col("source_error").isNull(), F.lit(False))
    return got.select(
        "mountain_id", "product", "task_id", "task_state", "attempt_count", "error_message", "destination", F.coalesce("destination_exists", F.lit(False)).alias("destination_exists"),
        F.coalesce("source_treeline30m_asset", F.lit("")).alias("source_treeline30m_asset"), F.coalesce("source_exists", F.lit(False)).alias("source_treeline30m_exists"), F.col("source_state").alias("source_treeline30m_task_state"),
        valid.alias("source_treeline30m_valid"), F.coalesce("source_error", F.lit("")).alias("source_treeline30m_validation_error"), "source_qa30m_exists", "gmba_area_km2", "bounds_area_km2", "bounds_to_gmba_area_ratio", "required_step1_tile_count",
        ((F.col("source_state") == "COMPLETED") & valid).alias("eligible_for_materialized_1km"), "failure_category",
    )


def integrity(errors: DataFrame, have: DataFrame, required: DataFrame) -> DataFrame:
    """One row: n_errors of the tile inventory, required tiles, the missing ones among them in order, and whether all is ready.

    have: (product, tile_id) of the inventory; required: tile_id.  A required
    tile that either product lacks is missing.  The missing ones are a list in
    one row as the report wants them; there are at most 648 tiles.
    """
    products = have.select("product", "tile_id").where("tile_id IS NOT NULL").groupBy("tile_id").agg(F.count_distinct("product").alias("n")).where("n >= 2")
    missing = required.select("tile_id").distinct().join(products, "tile_id", "left_anti")
    lists = missing.agg(F.array_sort(F.collect_list("tile_id")).alias("missing_required_tile_ids"))
    counts = required.agg(F.count_distinct("tile_id").alias("required_tiles"))
    got = errors.agg(F.count(F.lit(1)).alias("n_errors")).join(counts).join(lists)
    return got.withColumn("ready", (F.col("n_errors") == 0) & (F.size("missing_required_tile_ids") == 0))


def by_area(df: DataFrame, key: str, area: str) -> DataFrame:
    """(kind, key, area) of the smallest, the median and the largest row by area, ties by key; the median is at position n // 2 from zero."""
    order = [F.col(area).asc(), F.col(key).asc()]
    some = df.where(F.col(area).isNotNull())
    middle = some.count() // 2
    pick = lambda kind, rows: rows.limit(1).select(F.lit(kind).alias("kind"), key, area)
    return pick("smallest", some.orderBy(*order)).union(pick("median", some.orderBy(*order).offset(middle))).union(pick("largest", some.orderBy(F.col(area).desc(), F.col(key).asc())))
