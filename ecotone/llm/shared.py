"""Helpers that several operators use: shared storage, ordering, block pairs, components."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and Spark is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="ecotone-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and no executor's loss undoes it.

    What `drop_staged` has not deleted before goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what `stage` wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small fixed table as a plan of SQL functions."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df marked for broadcasting if it has at most `most` rows, counted now; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def range_bucket(df: DataFrame, key: str, rows: int, most: int = 8192) -> tuple[DataFrame, int]:
    """Add `_bucket`, the range of the numeric column `key` a row falls in, of about `rows` rows; returns the number of buckets too.

    The cut points are plain literals, so every plan that uses them agrees on
    the buckets, unlike sampled range partitions.  `most` of them come from
    quantiles over the whole column; where more buckets are needed each range
    is cut into equal steps, so their number grows with the rows.  Nulls fall
    in bucket 0 with the smallest keys.
    """
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).head()
    wanted = max(1, -(-facts["n"] // rows))
    buckets, steps = min(most, wanted), -(-wanted // most)
    cuts: list = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        cuts = sorted({c for c in df.agg(F.percentile_approx(key, at, max(10_000, 10 * buckets))).head()[0] or []})
    if not cuts:
        return df.withColumn("_bucket", F.lit(0)), 1
    # how many cut points lie at or below the key, by binary search over a literal array
    bound = F.lit(cuts)
    powers = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    low = F.aggregate(powers, F.lit(0), lambda a, p: F.when(F.try_element_at(bound, a + p) <= F.col(key), a + p).otherwise(a))
    got = df.withColumn("_bucket", F.coalesce(low, F.lit(0)))
    if steps > 1:
        first = F.coalesce(F.get(bound, F.col("_bucket") - 1), F.lit(facts["lo"])).cast("double")
        last = F.coalesce(F.get(bound, F.col("_bucket")), F.lit(facts["hi"])).cast("double")
        step = F.floor((F.col(key).cast("double") - first) / F.greatest(last - first, F.lit(1e-300)) * steps)
        got = got.withColumn("_bucket", F.col("_bucket") * steps + F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.coalesce(step, F.lit(0)))).cast("int"))
    return got, (len(cuts) + 1) * steps


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with one row for each value of `keys`, nulls being equal. Only rows that do repeat are exchanged whole."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    if not again.limit(1).count():
        return df
    again = stage(again, "again").withColumnsRenamed({k: f"_again_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in keys]
    return df.join(again, same, "left_anti").unionByName(df.join(again, same, "left_semi").dropDuplicates(keys))


def block_cells(df: DataFrame, keys: list[str], tie: str, size: int) -> DataFrame:
    """Deal the rows of each key out to cells, so that every two rows of a key meet in a cell and no cell exceeds about 2 x size rows.

    A key with n rows gets b = ceil(n / size) blocks and b(b+1)/2 cells (i, j),
    i <= j; a row of block k goes to the b cells that hold k.  Keys with one row
    are left out.  Adds `_i`, `_j`, `_k`.  The counts come from a partial
    aggregation and the join on hot keys can be split by adaptive execution.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    got = df.join(n, keys).withColumn("_b", F.ceil(F.col("_n") / size).cast("int"))
    got = got.withColumn("_k", F.pmod(F.xxhash64(F.col(tie), F.lit("block")), F.col("_b")).cast("int"))
    got = got.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return got.withColumns({"_i": F.least("_k", "_o"), "_j": F.greatest("_k", "_o")}).drop("_n", "_b", "_o")


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 1000) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (u, v), for every id that has a link to another.

    Every id takes the least label among its own label's and its neighbours'
    labels', and hands the least of its neighbours' on to its own label too, so
    whole trees are hooked and rounds grow with the logarithm of a chain's
    length (about 13 for 1,000 links, 19 for 100,000).  It ends when no label
    moves; labels that still move after most_rounds are an error, never a
    result.  Each round is written to the shared folder.  Hot ids only meet in
    partial aggregations and in joins that can be split.
    """
    both = edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stage(both.distinct(), f"{name}-edges")
    label = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), f"{name}-0")
    for k in range(1, most_rounds + 1):
        top = label.join(label.select(F.col("id").alias("label"), F.col("label").alias("top")), "label").select("id", "label", "top")
        near = both.join(top.select(F.col("id").alias("v"), "top"), "v").groupBy("u").agg(F.min("top").alias("m"))
        own = top.join(near.withColumnRenamed("u", "id"), "id")
        news = own.select(F.explode(F.array(F.struct("id", F.least("top", "m").alias("label"), F.col("label").alias("was")), F.struct(F.col("label").alias("id"), F.col("m").alias("label"), F.lit(None).cast(label.schema["label"].dataType).alias("was")))).alias("x")).select("x.*")
        new = stage(news.groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was")), f"{name}-{k}")
        moved = new.where("label <> was").limit(1).count()
        drop_staged(label) if not label.isEmpty() else None
        label = new.select("id", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"{name}: labels still move after {most_rounds} rounds")
    drop_staged(both)
    return label.withColumnRenamed("label", "component")


def worker_cache(name: str) -> dict:
    """What a Python worker keeps between tasks for one operator; an operator that starts lets go of the others'."""
    import sys

    kept = sys.__dict__.setdefault("_ecotone_kept", {})
    if others := [k for k in kept if k != name]:
        import ctypes

        import pyarrow as pa

        for other in others:
            del kept[other]
        # what the others freed goes back to the machine, not to this process's own reserve
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
    return kept.setdefault(name, {})


def by_group(rows, keys):
    """Cut one Arrow table, sorted by its integer key columns, into runs of equal keys."""
    import numpy as np

    if rows.num_rows == 0:
        return
    cols = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
        yield a, b


def stream_groups(batches, keys):
    """Arrow tables of whole groups from sorted batches: holds one batch and one group at a time."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        runs = list(by_group(t, keys))
        for a, b in runs[:-1]:
            yield t.slice(a, b - a)
        held = t.slice(runs[-1][0])
    if held is not None and held.num_rows:
        yield held


def forest(a, b, parent: dict | None = None):
    """Edges that connect what the links (a[i], b[i]) do: what components need, in linear size. With `parent`, over those and all links given with it before.

    An edge names the two trees that it joins by their least members, so edges
    from many cells with the same members are mostly the same few.
    """
    parent = {} if parent is None else parent

    def top(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(p, q), min(p, q)))
    return out


def cell_forest(a, b, same: bool, near, ids, step: int = 64) -> list:
    """The links that a cell of blocks a and b (row numbers) adds: near(x, y) gives the linked pairs of two lists of rows as two arrays, ids the rows' names.

    Links within a block are the business of the block's own cell (same): in
    any other cell they only tell which links across are new, so a large group
    of copies gives one link a cell, not one a row.  Rows should come by id:
    then a group of copies is a star around its least id in each cell.
    """
    parent: dict = {}

    def links(p, q, own):
        out = []
        for s in range(0, len(p), step):
            x, y = near(p[s : s + step], q)
            if own:
                x, y = x[x < y], y[x < y]
            out += forest(ids[x].tolist(), ids[y].tolist(), parent)
        return out

    if same:
        return links(a, a, True)
    links(a, a, True)
    links(b, b, True)
    return links(a, b, False)
