"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A text's words are its runs of non-space characters, its shingles are five
words each (fewer words: the whole sequence, no word: no shingle).  The sketch
is the k least of the distinct 48-bit hashes of the shingles.  Sketches of
parts merge to the sketch of the whole, and two sketches estimate resemblance,
containment and distinct counts.

Null texts count as empty; an empty text has an empty sketch, two empty
sketches resemble each other fully, an empty and another not at all.  Equal
texts have equal sketches.  Repeated ids are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecotone.llm.shared import GAPS, range_bucket, small, stage

K = 128
WIDTH = 5
BITS = 48


def word_hashes(text: Column) -> Column:
    """The hash of each word, in order."""
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), ""), lambda w: F.xxhash64(w))


def shingle_sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k least distinct shingle hashes. `words` is a column of word hashes that stands by itself in the plan."""
    many = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + j) for j in range(width))), 64 - BITS))
    few = F.array(F.shiftrightunsigned(F.xxhash64(words), 64 - BITS))
    shingles = F.when(F.size(words) >= width, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from its parts' sketches. Only hashes travel, and each key's are distinct before they meet."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    least = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    got = least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    return df.select(*keys).distinct().join(got, keys, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the least hashes of the union that both sketches hold."""
    least = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(shared / F.size(least))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_text(a: Column) -> Column:
    """The sketch as fixed-width hexadecimal digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def fingerprints(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """df with `sketch`, `fingerprint` and `distinct_shingles`."""
    got = df.withColumn("__w", word_hashes(F.col(text))).withColumn("sketch", shingle_sketch(F.col("__w"), k)).drop("__w")
    return got.withColumns({"fingerprint": as_text(F.col("sketch")), "distinct_shingles": distinct_count(F.col("sketch"), k)})


def with_next(df: DataFrame, key: str, payload: list[str], rows: int = 1024) -> DataFrame:
    """df's key and payload with `next_<payload>`: the row that follows by descending key; the first follows the last.

    Rows go to buckets of the key's range; the first row of each bucket also
    goes, as a copy, to the end of the bucket before it, so one exchange of the
    payload is enough and no task sees more than a bucket.
    """
    dealt, _ = range_bucket(df.select(key, *payload), key, rows)
    # a row for each bucket: the head of one goes to the end of that before it, the first's to the last's
    heads = stage(dealt.groupBy("_bucket").agg(F.max(key).alias("_head")), "next-heads")
    down = Window.orderBy(F.col("_bucket").desc())
    ends = Window.orderBy("_bucket")
    serves = heads.select(F.coalesce(F.lag("_bucket").over(down), F.first("_bucket").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"), "_head")
    copies = dealt.drop("_bucket").join(small(serves), F.col(key).eqNullSafe(F.col("_head")))
    copies = copies.select(key, *payload, F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))
    both = dealt.withColumn("_copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col(key).desc_nulls_last(), *(F.col(c) for c in payload))
    got = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in payload}).where("_copy = 0")
    return got.select(key, *payload, *(f"next_{c}" for c in payload))


def near_edited(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint, that of its edit with the following document's start, and the likenesses."""
    pairs = with_next(df.select(key, F.coalesce(text, F.lit("")).alias("text")), key, ["text"])
    half = F.expr("CAST(floor(length(text) / 2) AS INT)")
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    sha = F.sha2(F.col("_edited").cast("binary"), 256)
    got = pairs.select(key, "n_chars", sha.alias("edited_sha256"), *(word_hashes(F.col(c)).alias(n) for c, n in (("text", "_a"), ("_edited", "_b"), ("next_text", "_c"))))
    got = got.select(key, "n_chars", "edited_sha256", *(shingle_sketch(F.col(c), k).alias(n) for c, n in (("_a", "sketch"), ("_b", "_e"), ("_c", "_n"))))
    return got.select(
        key, "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("_e")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_e"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("_n"), k).alias("near_next"),
        containment(F.col("_e"), F.col("sketch"), k).alias("edited_containment"), distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
    )
