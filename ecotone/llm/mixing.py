"""Mixing sources to target weights, in DataFrame operations only.

Each source's words form one stream, its documents by ascending id, packed into
blocks of a fixed number of words.  A source's target is its share of all words
by weight, at most `most` times its own words, the excess reshared by weight.
The number of its slots follows from its target; each slot draws its output
shard by a hash, so the counts of the sources in the shards are multinomial,
conditioned on totals that meet the targets.  A slot finds its block through
the source's pseudorandom permutation of block numbers, one for each time round
the stream, so no block is taken more than `most` times; slots and blocks join
by block number, and the blocks go to their slots' shards (`mixed_blocks`; in
`mix` the number of a document's shards).  Nothing depends on partitions: runs
repeat exactly.

Null texts have no words, a null source is a source of its own (ordered last),
repeated rows each have their words.  Documents without words stay, with
nothing taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecotone.llm.shared import GAPS, WORD, range_bucket, small, stage

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block: this many, fewer only where the whole input has under FINE blocks.
BLOCK = 64
FINE = 4096
#: Slots of an output shard, on average.
SHARD = 4096
#: Odd multipliers of the permutations' rounds.
ODD = (741103, 597399, 1010977, 860941)
CHUNK = 8192


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h), written to the shared folder: the texts are read once. h tells repeated ids apart."""
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    return stage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(text).alias("h")), "mix-sizes")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: rank `s`, `source_size`, `target`, block length, blocks and slots. Only sums by source meet in one task."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    alone = Window.partitionBy(F.lit(0))
    by_name = alone.orderBy(F.col("source").asc_nulls_last())
    got = total.withColumn("s", F.row_number().over(by_name) - 1)
    got = got.withColumn("w", F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.col("s") % len(weights)).cast("int")))
    got = got.withColumns({"cap": (most * F.col("source_size")).cast("double"), "all_words": F.sum("source_size").over(alone), "all_w": F.sum("w").over(alone)})
    # water-filling: sources by cap over weight; the level is set by the first that its cap does not stop
    filled = alone.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumns({"before": F.coalesce(F.sum("cap").over(filled), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(filled), F.lit(0.0))})
    got = got.withColumn("level", (F.col("all_words") - F.col("before")) / (F.col("all_w") - F.col("w_before")))
    got = got.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("before", "level"))).over(alone)["level"])
    got = got.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("all_words") / FINE)))
    got = got.withColumn("block", block.cast("long"))
    got = got.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(most * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"))).otherwise(F.lit(0))
    return got.withColumn("slots", slots.cast("long")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(alone) / SHARD)).cast("long")).select("s", "source", "w", "source_size", "target", "block", "blocks", "slots", "shards")


def permutation(xor: str, right: str) -> list:
    """Expressions that in turn lead x (in 0 .. blocks-1) to its place under the permutation of (s, turn).

    A round mixes the numbers below the largest power of two (a multiplication
    by an odd number, a key, an exclusive or with the high bits) and turns the
    whole circle by about a half, so every number is mixed in one of two
    rounds.  Each step is a bijection of 0 .. blocks-1.  `bits` is the power's exponent;
    xor and right name the dialect's operations.
    """
    power = "CAST(power(2, bits) AS BIGINT)"
    out = []
    for j, odd in enumerate(ODD):
        out.append(f"CASE WHEN x < {power} THEN (x * {odd} + s * 7919 + turn * 104729 + {j * 65537 + 1}) % {power} ELSE x END")
        out.append(f"CASE WHEN x < {power} THEN {xor.format('x', right.format('x', 'CAST(floor((bits + 1) / 2.0) AS INT)'))} ELSE x END")
        out.append(f"(x + blocks - CAST(floor(blocks / 2.0) AS BIGINT) + {j}) % blocks")
    return out


def shard(xor: str, right: str) -> list:
    """Expressions that in turn lead y (a slot's number) to its shard."""
    return [
        "((y % 2147483648) * 1103515245 + s * 12345 + 42) % 2147483648", xor.format("y", right.format("y", "15")),
        "(y * 69069 + 1) % 2147483648", xor.format("y", right.format("y", "13")), "y % shards",
    ]


def draw(sources: DataFrame) -> DataFrame:
    """(s, slot, shard, turn, block_no): every slot of the mix."""
    chunks = sources.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))).alias("c"))
    # the rows are few and small until they are exploded, so the number of tasks is given
    tasks = (sources.agg(F.sum("slots")).head()[0] or 0) // (8 * CHUNK) + 1
    chunks = chunks.repartition(tasks, "s", "c")
    slots = chunks.select("s", "blocks", "shards", F.explode(F.sequence(F.col("c") * CHUNK, F.least("slots", (F.col("c") + 1) * CHUNK) - 1)).alias("slot"))
    slots = slots.withColumn("s", F.col("s").cast("long")).withColumns({"turn": F.expr("slot div blocks"), "x": F.col("slot") % F.col("blocks"), "y": F.col("slot"), "bits": F.length(F.bin("blocks")) - 1})
    # each step is bound to a lambda's variable: as plain expressions they would multiply out
    bound = lambda name, steps: reduce(lambda e, step: f"get(transform(array({e}), {name} -> CAST({step} AS BIGINT)), 0)", steps, name)
    slots = slots.withColumns({"x": F.expr(bound("x", permutation("({} ^ {})", "shiftright({}, {})"))), "y": F.expr(bound("y", shard("({} ^ {})", "shiftright({}, {})")))})
    return slots.select(F.col("s").cast("int").alias("s"), "slot", F.col("y").alias("shard"), "turn", F.col("x").alias("block_no"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, s, slots): the drawn counts."""
    return slots.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("slots"))


def placed(sizes: DataFrame, sources: DataFrame, rows: int = 4096) -> DataFrame:
    """Each document with the place `start` of its first word in its source's stream: running sums in id ranges, on top of the ranges' sums."""
    dealt, _ = range_bucket(sizes, "doc_id", rows)
    dealt = dealt.join(small(sources.select("s", "source", "block").withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sums = dealt.groupBy("s", "_bucket").agg(F.sum("size").alias("n"))
    base = sums.select("s", "_bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("_bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("_bucket", "s").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["s", "_bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "_bucket")


def segments(docs: DataFrame) -> DataFrame:
    """(s, block_no, doc_id, h, start, size, lo, hi): the parts of documents in each block; lo and hi count the document's words."""
    got = docs.where("size > 0").select("s", "doc_id", "h", "start", "size", "block", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")).alias("block_no"))
    return got.select("s", "block_no", "doc_id", "h", "start", "size", (F.greatest("start", F.col("block_no") * F.col("block")) - F.col("start")).alias("lo"), (F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.col("start")).alias("hi"))


def taken(docs: DataFrame, sources: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): words that the mix takes, and output shards that hold any."""
    times = slots.groupBy("s", "block_no").agg(F.collect_list("shard").alias("at"))
    # the slots come from a table of a row per source, so the planner takes them for few: it must not broadcast them
    got = segments(docs).hint("merge").join(times.hint("merge"), ["s", "block_no"], "left")
    words = F.sum((F.col("hi") - F.col("lo")) * F.coalesce(F.size("at"), F.lit(0)))
    got = got.groupBy("s", "doc_id", "h", "start", "size").agg(words.alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("shards")).drop("h")
    none = docs.where("size = 0").select("s", "doc_id", "start", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("shards"))
    return got.unionByName(none).join(small(sources.select("s", "source_size", "target")), "s").select("doc_id", "size", "source_size", "target", "taken", "shards")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words the mix takes of each document."""
    sizes = sized(df, key, text, source)
    sources = stage(targets(sizes), "mix-sources")
    return taken(placed(sizes, sources), sources, draw(sources))


def _words(text: str):
    """A text's words, each with the gap before it."""
    return F.regexp_extract_all(text, F.lit(f"(?:{GAPS})?{WORD}"), F.lit(0))


def numbered(df: DataFrame, key: str, into: str, order: str | None = None) -> DataFrame:
    """df with the number of each row among those of its key, from 1; in order of a column, or in any.

    Rows of a key are numbered within their partition, on top of the counts of
    the partitions before, so a hot key is never in one task.
    """
    if order:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(key).orderBy(order)))
    part = df.withColumn("__part", F.spark_partition_id())
    counts = part.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select(key, "__part", (F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).alias("__base"))
    inside = part.withColumn(into, F.row_number().over(Window.partitionBy(key, "__part").orderBy(F.lit(0))))
    return inside.join(base, [key, "__part"]).withColumn(into, (F.col(into) + F.col("__base")).cast("int")).drop("__part", "__base")


def with_spans(df: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(__row, __text, and spans' columns): df's rows joined with spans (doc_id, h, start, ...).

    Repeated rows of an id and text have a place each in the stream: the copies
    are numbered on both sides, only where there are any.
    """
    own = F.struct(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"))
    spans = spans.withColumn("__key", F.struct("doc_id", "h")).drop("doc_id", "h")
    rows = df.select(own.alias("__key"), F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"))
    if not spans.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return rows.join(spans, "__key").drop("__key")
    return numbered(rows, "__key", "__copy").join(numbered(spans, "__key", "__copy", "start"), ["__key", "__copy"]).drop("__key", "__copy")


def mixed_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows as the mix takes them: a row for each time round in which it takes some of the document, its text that part.

    Only (id, hash, word ranges) and the texts, once, are exchanged; n_chars,
    where df has it, is that of the new text.
    """
    sizes = sized(df, key, text, source)
    sources = stage(targets(sizes), "mix-sources")
    parts = segments(placed(sizes, sources)).hint("merge").join(draw(sources).select("s", "block_no", "turn").hint("merge"), ["s", "block_no"])
    spans = parts.groupBy("doc_id", "h", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    spans = stage(spans.groupBy("doc_id", "h", "start").agg(F.array_sort(F.collect_list(F.struct("turn", "spans"))).alias("__turns")), "mix-spans")
    got = with_spans(df, spans, key, text)
    part = lambda w, t: F.array_join(F.flatten(F.transform(t["spans"], lambda x: F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), "")
    # the words are bound to a lambda's variable, so a text is split once
    news = F.get(F.transform(F.array(_words("__text")), lambda w: F.transform("__turns", lambda t: part(w, t))), F.lit(0))
    out = got.select("__row", F.explode(news).alias("__new"))
    fresh = {text: F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return out.select(*(fresh.get(c, F.col("__row")[c]).alias(c) for c in df.columns))


def mixed_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, slot, source, block_no, text): the mix itself, a row for each slot, its text the block of the source's stream."""
    sizes = sized(df, key, text, source)
    sources = stage(targets(sizes), "mix-sources")
    parts = segments(placed(sizes, sources)).groupBy("s", "doc_id", "h", "start").agg(F.collect_list(F.struct("block_no", "lo", "hi")).alias("__parts"))
    got = with_spans(df, stage(parts, "mix-parts"), key, text)
    cut = F.get(F.transform(F.array(_words("__text")), lambda w: F.transform("__parts", lambda x: F.struct(x["block_no"].alias("block_no"), F.array_join(F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), "").alias("t")))), F.lit(0))
    pieces = got.select("s", "start", F.inline(cut))
    blocks = pieces.groupBy("s", "block_no").agg(F.array_sort(F.collect_list(F.struct("start", "t"))).alias("p")).select("s", "block_no", F.trim(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text"))
    return draw(sources).hint("merge").join(blocks.hint("merge"), ["s", "block_no"]).join(small(sources.select("s", "source")), "s").select("shard", "slot", "source", "block_no", "text")


def _steps(name: str, start: str, column: str, steps: list) -> str:
    """A chain of table expressions, each replacing a column."""
    return ",\n".join(f"{name}{k + 1} AS (SELECT * REPLACE (CAST({step} AS BIGINT) AS {column}) FROM {name}{k})" for k, step in enumerate(steps)).join((f"{name}0 AS ({start}),\n", ""))


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM t),
w AS (SELECT *, CASE s % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS all_words FROM r),
f AS (SELECT *, sum(w) OVER () AS all_w, coalesce(sum(cap) OVER o, 0) AS bef, coalesce(sum(w) OVER o, 0) AS w_bef FROM w
      WINDOW o AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_words - bef) / (all_w - w_bef) AS lv FROM f),
m AS (SELECT arg_min(lv, bef) AS level FROM l WHERE lv * w <= cap),
g AS (SELECT s, source, source_size, least(cap, coalesce(level * w, cap)) AS target, greatest(1, least(64, all_words // 4096))::BIGINT AS block FROM l, m),
b AS (SELECT *, ((source_size + block - 1) // block)::BIGINT AS blocks FROM g),
n AS (SELECT *, CASE WHEN source_size > 0 THEN least(3 * blocks, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) ELSE 0 END AS slots FROM b),
sh AS (SELECT *, greatest(1, CAST(ceil(sum(slots) OVER () / 4096.0) AS BIGINT)) AS shards FROM n),
{_steps("x", "SELECT s, blocks, shards, j AS slot, j // blocks AS turn, j % blocks AS x, j AS y, length(bin(blocks)) - 1 AS bits FROM (SELECT s, blocks, shards, unnest(range(0, slots)) AS j FROM sh) AS u", "x", permutation("xor({}, {})", "({} >> {})"))},
{_steps("y", f"SELECT * FROM x{3 * len(ODD)}", "y", shard("xor({}, {})", "({} >> {})"))},
c AS (SELECT s, x AS block_no, count(*) AS times, list(y) AS drawn FROM y5 GROUP BY ALL),
p AS (SELECT n.s, doc_id, size, source_size, target, block, coalesce(sum(size) OVER (PARTITION BY n.s ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
q AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // block, (start + size - 1) // block + 1) ELSE [NULL] END) AS block_no FROM p)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(coalesce(sum((least(start + size, (q.block_no + 1) * block) - greatest(start, q.block_no * block)) * times), 0) AS BIGINT) AS taken,
       CAST(coalesce(len(list_distinct(flatten(list(drawn) FILTER (WHERE drawn IS NOT NULL)))), 0) AS BIGINT) AS shards
FROM q LEFT JOIN c ON q.s = c.s AND q.block_no = c.block_no GROUP BY doc_id
"""
