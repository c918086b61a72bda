"""Registries, guards and reports as tables.

A registry row has mountain_id, product, destination, description,
configuration_hash, state, task_id, attempt_count and error_message.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecotone.functions.scalars import FAILURE_CATEGORIES, failure_category, out_of_memory, safe_name

#: The products of a mountain, and the states of a task that holds a queue place.
PRODUCTS = ("treeline30m", "treeline1km", "qa30m")
ACTIVE = ("READY", "RUNNING")
QUEUE_LIMIT = 3000


@dataclass(frozen=True)
class Settings:
    """What decides the results of a run."""

    canopy_thresholds: tuple = (3, 5)
    mmu_max_size: int = 500
    mmu_area_m2: float = 5000.0
    window_radius_m: float = 150.0
    least_samples: int = 5
    least_rise_m: float = 0.0
    otsu_least_samples: int = 20
    temperature_scale: float = 0.1
    temperature_offset: float = -273.15
    least_hm_fraction: float = 0.5
    most_tree_fraction: float = 0.9
    queue_limit: int = QUEUE_LIMIT

    def __post_init__(self):
        if not self.canopy_thresholds or any(t <= 0 for t in self.canopy_thresholds) or len(set(self.canopy_thresholds)) != len(self.canopy_thresholds):
            raise ValueError("canopy thresholds must be positive and different")
        if not 1 <= self.queue_limit <= QUEUE_LIMIT:
            raise ValueError(f"the queue limit must lie in 1..{QUEUE_LIMIT}")
        if not 0 <= self.least_hm_fraction or not 0 <= self.most_tree_fraction <= 1 or self.window_radius_m <= 0 or self.least_samples < 2:
            raise ValueError("fractions, window and sample sizes must make sense")

    def digest(self) -> str:
        return canonical_sha256(asdict(self))

    def dry_run(self, mountains: int | None) -> dict:
        """What a run would do; nothing is read."""
        n = mountains or 0
        return {"configuration_hash": self.digest(), "mountains": n, "exports": n * len(PRODUCTS), "starts_tasks": False}


def canonical_sha256(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def receipt_matches(receipt: dict, identity: dict) -> list[str]:
    """Why a validation receipt cannot be trusted for an identity; empty if it can."""
    facts = receipt.get("analysis_table") or {}
    integrity = receipt.get("step1_integrity") or {}
    found = []
    if receipt.get("upstream_identity") != json.dumps(identity, sort_keys=True, separators=(",", ":")):
        found.append("another upstream identity")
    if not integrity.get("ready") or integrity.get("errors") or integrity.get("missing_required_tile_ids"):
        found.append("the tiles were not complete")
    if facts.get("selected_feature_count") != facts.get("distinct_gmba_id_count"):
        found.append("mountain ids were not unique")
    if (receipt.get("deep_check") or {}).get("status") not in ("PASSED", "OK", "passed"):
        found.append("no deep check passed")
    return found


def planned(mountains: DataFrame, root: str, settings_hash: str, products=PRODUCTS) -> DataFrame:
    """A PLANNED row for each mountain and product."""
    rows = mountains.select("mountain_id", F.explode(F.array(*map(F.lit, products))).alias("product"))
    safe = F.coalesce(safe_name(F.col("mountain_id")), F.raise_error(F.lit("a mountain_id has no character that a name may have")).cast("string"))
    name = F.concat_ws("_", "product", safe)
    return rows.select("mountain_id", "product", F.concat(F.lit(f"{root}/"), "product", F.lit("/"), name).alias("destination"), name.alias("description"), F.lit(settings_hash).alias("configuration_hash"), F.lit("PLANNED").alias("state"))


def resume_guarded(records: DataFrame, assets: DataFrame, tasks: DataFrame, resume: bool) -> DataFrame:
    """records with `state` and `conflict`: existing assets and active tasks are skipped when resuming, conflicts otherwise.

    An existing asset with another or no configuration hash is always a
    conflict, and an asset goes before a task.  assets: destination and
    asset_hash; tasks: description, task_state, active_id.
    """
    active = tasks.where(F.col("task_state").isin(*ACTIVE)).groupBy("description").agg(F.max("active_id").alias("active_id"))
    got = records.join(assets.select("destination", "asset_hash", F.lit(True).alias("_asset")), "destination", "left").join(active.withColumn("_task", F.lit(True)), "description", "left")
    other = F.col("_asset") & ~F.col("asset_hash").eqNullSafe(F.col("configuration_hash"))
    conflict = F.when(other, "different configuration").when(F.col("_asset") & F.lit(not resume), "asset exists").when(F.col("_asset").isNull() & F.col("_task") & F.lit(not resume), "task active")
    state = F.when(conflict.isNotNull(), F.col("state")).when(F.col("_asset"), "SKIPPED_EXISTING").when(F.col("_task") & (F.col("state") == "PLANNED"), "SKIPPED_ACTIVE").otherwise(F.col("state"))
    return got.select("mountain_id", "product", "destination", "description", "configuration_hash", state.alias("state"), conflict.alias("conflict"), F.when(state == "SKIPPED_ACTIVE", F.col("active_id")).alias("task_id"))


def queue_use(tasks: DataFrame, records: DataFrame, limit: int, planned_state: str = "PREFLIGHTED") -> DataFrame:
    """One row: tasks that wait, new ones, both, and whether that is within the limit."""
    ready = tasks.agg(F.count_if(F.col("task_state") == "READY").alias("existing_ready"))
    new = records.agg(F.count_if(F.col("state") == planned_state).alias("new_tasks"))
    return ready.join(new).withColumn("projected_ready", F.col("existing_ready") + F.col("new_tasks")).withColumn("within_limit", F.col("projected_ready") <= limit)


def recovered(records: DataFrame, tasks: DataFrame, last: bool = True) -> DataFrame:
    """records with missing task ids filled in from tasks (description, active_id, seen) of the same description: the last seen, or the first."""
    pick = F.max_by("active_id", F.struct("seen", "active_id")) if last else F.min_by("active_id", F.struct("seen", "active_id"))
    found = tasks.groupBy("description").agg(pick.alias("_id"))
    return records.join(found, "description", "left").withColumn("task_id", F.coalesce("task_id", "_id")).drop("_id")


def normalized(records: DataFrame, live: DataFrame) -> DataFrame:
    """records with task_state, attempt_count and error_message, from the live status (task_id, live_state, live_attempt, live_error) where there is one."""
    got = records.join(live.select("task_id", "live_state", "live_attempt", "live_error", F.lit(True).alias("_live")), "task_id", "left")
    text = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in cs), F.lit(""))
    state = F.coalesce(F.when(F.col("_live"), F.col("live_state")).otherwise(F.col("state")), F.lit("UNKNOWN"))
    return got.select(*[c for c in records.columns if c not in ("state", "attempt_count", "error_message")], state.alias("task_state"), F.coalesce("live_attempt", "attempt_count").alias("attempt_count"), text("live_error", "error_message").alias("error_message"))


def by_product(tasks: DataFrame, value: Column) -> DataFrame:
    """mountain_id and a column for each product; two rows of one are an error in `duplicates`."""
    got = tasks.groupBy("mountain_id").pivot("product", list(PRODUCTS)).agg(F.max(value))
    twice = tasks.groupBy("mountain_id", "product").agg(F.count(F.lit(1)).alias("n")).groupBy("mountain_id").agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    return got.join(twice, "mountain_id")


def diagnosed(status: DataFrame) -> DataFrame:
    """normalized rows with the state of the mountain's source task, the failure category and whether the source allows the 1 km product.

    The source of a mountain is one row, so a window over the mountain's few
    rows does for the lookup.
    """
    own = Window.partitionBy("mountain_id")
    source = F.coalesce(F.max(F.when(F.col("product") == "treeline30m", F.col("task_state"))).over(own), F.lit("MISSING"))
    got = status.withColumn("source_state", source)
    done = F.col("source_state") == "COMPLETED"
    return got.withColumns({"failure_category": failure_category(F.col("product"), F.col("task_state"), F.col("error_message"), done), "eligible": done})


def failure_counts(diagnosis: DataFrame) -> DataFrame:
    """(failure_category, n) with a row for every category, also those that did not occur."""
    every = diagnosis.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FAILURE_CATEGORIES))).alias("failure_category"))
    n = diagnosis.where("failure_category IS NOT NULL").groupBy("failure_category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "failure_category", "left").select("failure_category", F.coalesce("n", F.lit(0)).alias("n"))


def failed_only(status: DataFrame) -> DataFrame:
    """Mountains whose 1 km task ran out of memory though their source was completed, numeric ids first."""
    at = lambda p, c: F.max(F.when(F.col("product") == p, c))
    got = status.groupBy("mountain_id").agg(at("treeline1km", (F.col("task_state") == "FAILED") & out_of_memory(F.col("error_message"))).alias("f"), at("treeline30m", F.col("task_state") == "COMPLETED").alias("c"))
    return got.where("f AND c").select("mountain_id").orderBy(F.expr("try_cast(mountain_id AS BIGINT)").asc_nulls_last(), "mountain_id")


#: What a tile's record must say.
TILE_BANDS = ("tree_2000", "tree_2020")
TILE_THRESHOLDS = {"h3m": 3, "h5m": 5}


def inventory_errors(assets: DataFrame, expected: DataFrame, manifest_hash: str | None = None, max_size: int = 500) -> DataFrame:
    """(product, tile_id, error) for every rule that the tile inventory breaks; empty if it is ready.

    assets: product, tile_id, bands (array), type, sizeBytes (text),
    mmu_max_size, canopy_threshold_m, configuration_hash, grid, task_state;
    expected: tile_id.  Rules over all tiles have no tile_id.
    """
    a = assets.withColumn("tile_id", F.when(F.col("tile_id") != "", F.col("tile_id")))
    per = F.col("product")
    threshold = F.when(per == "h3m", TILE_THRESHOLDS["h3m"]).when(per == "h5m", TILE_THRESHOLDS["h5m"])
    rules = {
        "invalid bands": ~F.col("bands").eqNullSafe(F.array(*map(F.lit, TILE_BANDS))),
        "invalid type": ~F.col("type").eqNullSafe(F.lit("IMAGE")),
        "empty asset": F.coalesce(F.expr("try_cast(sizeBytes AS BIGINT)"), F.lit(0)) <= 0,
        "invalid max size": ~F.col("mmu_max_size").eqNullSafe(F.lit(max_size)),
        "wrong canopy threshold": ~F.col("canopy_threshold_m").eqNullSafe(threshold),
        "missing configuration hash": F.coalesce("configuration_hash", F.lit("")) == "",
        "failed tile": F.coalesce(F.col("task_state").isin("FAILED", "CANCELLED"), F.lit(False)),
    }
    named = a.where("tile_id IS NOT NULL")
    broken = F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules.items())), lambda e: e.isNotNull())
    out = named.select("product", "tile_id", F.explode(broken).alias("error"))
    row = lambda df, name: df.select("product", "tile_id", F.lit(name).alias("error"))
    out = out.unionByName(row(a.where("tile_id IS NULL"), "missing tile_id"))
    out = out.unionByName(row(named.groupBy("product", "tile_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate tile"))
    have = named.select("product", "tile_id").distinct()
    wanted = expected.select(F.explode(F.array(*map(F.lit, TILE_THRESHOLDS))).alias("product"), "tile_id")
    out = out.unionByName(row(wanted.join(have, ["product", "tile_id"], "left_anti"), "missing tile"))
    sets = have.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") < 2).alias("n"))
    whole = lambda df, name: df.select(F.lit(None).cast("string").alias("product"), F.lit(None).cast("string").alias("tile_id"), F.lit(name).alias("error"))
    out = out.unionByName(whole(sets.where("n > 0"), "tile sets differ"))
    hashes = named.agg(F.count_distinct(F.when(F.col("configuration_hash") != "", F.col("configuration_hash"))).alias("n"), F.max("configuration_hash").alias("h"), F.count_distinct("grid").alias("g"))
    out = out.unionByName(whole(hashes.where("n <> 1"), "mixed configuration hashes"))
    if manifest_hash is not None:
        out = out.unionByName(whole(hashes.where((F.col("n") == 1) & (F.col("h") != manifest_hash)), "hash differs from the manifest"))
    return out.unionByName(whole(hashes.where("g <> 1"), "mixed grids"))


def table_facts(df: DataFrame, key: str, required: list[str], hm: str, tree: str, unit: str, least: float = 0.5, most: float = 0.9) -> DataFrame:
    """One row of facts on an analysis table: rows, complete rows, distinct ids, rows out of bounds, least and largest fraction, units."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("complete_rows"), F.count_distinct(key).alias("distinct_ids"), F.count_if(F.col(hm) < least).alias("below_hm"), F.count_if(F.col(tree) > most).alias("above_tree"), F.min(hm).alias("least_hm"), F.max(hm).alias("largest_hm"), F.count_distinct(unit).alias("units"))


def representative(df: DataFrame, key: str) -> DataFrame:
    """The middle row by key: that at position n // 2, counted from zero."""
    return df.orderBy(key).offset(df.count() // 2).limit(1)
