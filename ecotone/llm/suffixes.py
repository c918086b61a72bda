"""Repeated passages by a sparse suffix array over words.

Of every stretch of LENGTH words the k-gram of least hash is a sample point, so
two equal stretches have the same one.  Sample points whose k-gram occurs once
are done with.  The suffixes at the others are sorted, those of one k-gram
together, or by range over the cluster where it has more than HOT.  A suffix
carries the 64-bit hashes of the stretches of LENGTH words around its sample
point: neighbours are compared by these, which extends a match left and right
from the point word by word, and neighbours with a stretch in common make runs.
The same stretch may stand in several runs, where other suffixes lie between:
the runs of a k-gram are then matched by their stretch's hash, in the task that
holds the whole k-gram, or over the cluster where it is cut.  So every stretch
that stands twice is found, and no other; its place of smallest (id, text
hash, position) keeps it, null ids last, the others are repeats of it.

Passages are equal word by word (runs of non-space characters).  Repeats within
one document count too.  Null, empty and short texts have no passage.  Rows with
equal id and text are one document, and both get its spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecotone.llm.shared import GAPS, WORD, once, small, stage, worker_cache

#: Words of the shortest passage, and of a sample point's k-gram.
LENGTH = 50
GRAM = 10
LEFT = LENGTH - GRAM
#: Characters hashed at a time.
CHUNK = 500_000
#: Sample points of a k-gram from which it is sorted by range, and rows of such a range.
HOT = 20_000
RANGE_ROWS = 20_000

MULTIPLY = 0x9E3779B97F4A7C15


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list) -> tuple:
    """(hash of every word of the texts, number of words of each text)."""
    import numpy as np

    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*blobs, b""]), dtype=np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    limits = np.cumsum([len(b) + 1 for b in blobs])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lens = ends - starts
    letters = data[~gap].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lens) - lens
    place = np.arange(len(letters)) - np.repeat(first, lens)
    power = np.full(int(lens.max()), MULTIPLY, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return _mixed(np.add.reduceat(letters * power[place], first) + lens.astype(np.uint64)), counts


def window_hashes(words):
    """The hash of each stretch of LENGTH words, by its first word."""
    import numpy as np

    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = (np.full(len(words), np.uint64(m)) for m in (MULTIPLY, pow(MULTIPLY, -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * np.multiply.accumulate(up), dtype=np.uint64)])
    return _mixed((sums[LENGTH:] - sums[:n]) * np.multiply.accumulate(down)[:n])


def sample_points(words, counts) -> tuple:
    """(index, k-gram hash, least and most words before it) of the sample points; the last two name the stretches that have it. A stretch never crosses from one text to the next."""
    import numpy as np

    n = len(words) - GRAM + 1
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(words) < LENGTH:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
    gram = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(MULTIPLY) + words[j : j + n]
    gram = _mixed(gram)
    least, at, width = gram, np.arange(n), 1
    while width < LEFT + 1:
        step = min(width, LEFT + 1 - width)
        right = least[step:] < least[: len(least) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        width += step
    starts = np.flatnonzero(doc[: len(at)] == doc[LENGTH - 1 : LENGTH - 1 + len(at)])
    at = at[starts]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    got = at[first]
    return got, gram[got], got - starts[last], got - starts[first]


def _chunks(column):
    texts, size, start = [], 0, 0
    for k, v in enumerate(column):
        t = v.as_py() or ""
        if texts and size + len(t) > CHUNK:
            yield start, texts
            texts, size, start = [], 0, k
        texts.append(t)
        size += len(t)
    if texts:
        yield start, texts


def grams(docs: DataFrame) -> DataFrame:
    """(id, h, pos, g, lo, hi): the sample points of (id, h, text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_cache("suffixes")
        for batch in batches:
            for start, texts in _chunks(batch.column(2)):
                words, counts = word_hashes(texts)
                at, g, lo, hi = sample_points(words, counts)
                first = np.cumsum(counts) - counts
                d = np.searchsorted(first, at, side="right") - 1
                # an empty text shares its first word's index with the text after it
                take = pa.array(d + start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((at - first[d]).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(lo.astype(np.int8)), pa.array(hi.astype(np.int8))], ["id", "h", "pos", "g", "lo", "hi"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, pos int, g long, lo byte, hi byte")


def suffixes(docs: DataFrame) -> DataFrame:
    """(g, r, id, h, pos, hi, w, hot): for (id, h, text, at) a byte of each word from the sample point on, by which suffixes are sorted, and the hashes w of its stretches, that with most words before the point first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["g", "r", "id", "h", "pos", "hi", "w", "hot"]
        for batch in batches:
            for start, texts in _chunks(batch.column(2)):
                at = batch.column(3).slice(start, len(texts)).to_pylist()
                words, counts = word_hashes(texts)
                short, hashes = words.astype(np.uint8).tobytes(), window_hashes(words).tobytes()
                out, first = [], 0
                for k, n in enumerate(counts.tolist()):
                    for p in at[k]:
                        pos, hi = p["pos"], p["hi"]
                        here = first + pos
                        out.append((p["g"], short[here : min(here + LENGTH, first + n)], start + k, pos, hi, hashes[8 * (here - hi) : 8 * (here - p["lo"] + 1)], p["hot"]))
                    first += n
                if out:
                    g, r, d, pos, hi, w, hot = zip(*out, strict=True)
                    take = pa.array(d)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(r, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(hi, pa.int8()), pa.array(w, pa.binary()), pa.array(hot)], names)

    return docs.mapInArrow(run, f"g long, r binary, id {docs.schema['id'].dataType.simpleString()}, h long, pos int, hi byte, w binary, hot boolean")


def neighbours(rows, whole) -> tuple:
    """Compare sorted suffixes with their neighbours: (spans, runs).

    `whole` tells of each row whether all suffixes of its k-gram are here.  A
    span is (row, start, end, kept, owner row) of stretches that stand twice; a
    run (row, start, hash) is a stretch at the smallest place of its run, of a
    k-gram that is not whole.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = rows.num_rows
    g, pos, hi = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("g", "pos", "hi"))
    hi = hi.astype(np.int64)
    places = pa.table({c: rows.column(c) for c in ("id", "h", "pos")})
    placed = pc.sort_indices(places, sort_keys=[(c, "ascending") for c in ("id", "h", "pos")], null_placement="at_end").to_numpy().astype(np.int64)
    rank = np.empty(n, dtype=np.int64)
    rank[placed] = np.arange(n)
    w = rows.column("w").to_pylist()
    counts = np.fromiter(map(len, w), dtype=np.int64, count=n) // 8
    flat = np.frombuffer(b"".join(w), dtype=np.uint64)
    base = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), counts)
    before = hi[row] - (np.arange(len(flat)) - base[row])  # words before the point
    # the same stretch of the suffix before
    last = np.maximum(row - 1, 0)
    at = hi[last] - before
    there = (row > 0) & (g[row] == g[last]) & (at >= 0) & (at < counts[last])
    other = np.where(there, base[last] + at, 0)
    same = there & (flat[other] == flat)
    root = np.where(same, other, np.arange(len(flat)))
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    owner, size = np.full(len(flat), n, dtype=np.int64), np.bincount(root, minlength=len(flat))
    np.minimum.at(owner, root, rank[row])
    # runs of one stretch, where other suffixes lie between
    here = np.flatnonzero((root == np.arange(len(flat))) & whole[row])
    here = here[np.lexsort((owner[here], flat[here]))]
    new = np.diff(flat[here], prepend=flat[here[:1]] + np.uint64(1)) != 0
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    owner[here], size[here] = owner[here[first]][group], np.bincount(group, weights=size[here]).astype(np.int64)[group]
    found = np.flatnonzero(size[root] > 1)
    who = placed[owner[root[found]]] if len(found) else found
    cut = np.ones(len(found), dtype=bool)
    cut[1:] = (np.diff(found) != 1) | (np.diff(row[found]) != 0) | (np.diff(who) != 0)
    a = np.flatnonzero(cut)
    b = np.concatenate([a[1:], [len(found)]])[: len(a)] - 1
    mine = row[found[a]]
    spans = (mine, pos[mine] - before[found[a]], pos[mine] - before[found[b]] + LENGTH, mine == who[a], who[a])
    open_ = np.flatnonzero((root == np.arange(len(flat))) & ~whole[row])
    own = placed[owner[open_]] if len(open_) else open_
    return spans, (own, pos[own] - before[open_], flat[open_])


def matches(sorted_rows: DataFrame, cut: bool) -> DataFrame:
    """(id, h, start, end, kept, owner, w): spans, and with w not null the runs of k-grams that a task may hold only in part (cut: any at the ends of a batch; else a task holds k-grams whole)."""
    kind = sorted_rows.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["id", "h", "start", "end", "kept", "owner", "w"]

        def table(rows, whole):
            (r, start, end, kept, who), (own, begin, w) = neighbours(rows, whole)
            ids, h, take = rows.column("id"), rows.column("h"), pa.array(np.concatenate([r, own]))
            none = lambda k, t: pa.nulls(k, t)
            owner = pa.chunked_array([*ids.take(pa.array(who)).chunks, none(len(own), ids.type)], ids.type)
            cols = [ids.take(take), h.take(take), pa.array(np.concatenate([start, begin]).astype(np.int32)), pa.array(np.concatenate([end, begin + LENGTH]).astype(np.int32)), pa.array(np.concatenate([kept, np.ones(len(own), dtype=bool)])), owner, pa.chunked_array([none(len(r), pa.int64()), pa.array(w.view(np.int64))])]
            yield from pa.table(cols, names).combine_chunks().to_batches()

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
                held = None
            if not rows.num_rows:
                continue
            g = rows.column("g").to_numpy()
            if cut:
                yield from table(rows, (g != g[0]) & (g != g[-1]))
                continue
            edge = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            held = rows.slice(edge)
            if edge:
                yield from table(rows.slice(0, edge), np.ones(edge, dtype=bool))
        if held is not None and held.num_rows:
            yield from table(held, np.ones(held.num_rows, dtype=bool))

    return sorted_rows.mapInArrow(run, f"id {kind}, h long, start int, end int, kept boolean, owner {kind}, w long")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h, start, end, kept, owner): word ranges of documents that other places repeat; h is the text's hash, owner has the passage at an earlier place (kept: itself)."""
    docs = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where(F.length("text") >= 2 * LENGTH - 1)
    docs = once(docs, ["id", "h"])
    points = stage(grams(docs), "suffix-points")
    often = points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = stage(often.where(F.col("n") > HOT), "suffix-hot")
    facts = hot.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).head()
    listed = small(hot.select("g"))
    # a frequent k-gram never meets in one task: its points are taken out before the others are joined
    rare = points.join(listed, "g", "left_anti") if facts["k"] else points
    some = rare.join(often.select("g"), "g").withColumn("hot", F.lit(False))
    if facts["k"]:
        some = some.unionByName(points.join(listed, "g").withColumn("hot", F.lit(True)))
    at = some.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "g", "lo", "hi", "hot")).alias("at"))
    some = docs.join(at.withColumnsRenamed({"id": "_id", "h": "_h"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("id", "h", "text", "at")
    rows, order = suffixes(some), ["g", "r", "id", "h", "pos"]
    if facts["k"]:
        rows = stage(rows, "suffix-rows")
    spans = matches(rows.where("NOT hot").drop("hot").repartition("g").sortWithinPartitions(*order), cut=False).drop("w")
    if facts["k"]:
        ranges = max(2, -(-facts["n"] // RANGE_ROWS))
        parts = stage(matches(rows.where("hot").drop("hot").repartitionByRange(ranges, *order).sortWithinPartitions(*order), cut=True), "suffix-runs")
        place = F.struct(F.col("id").isNull().alias("n"), "id", "h", "start")
        runs = parts.where("w IS NOT NULL").withColumn("place", place)
        first = runs.groupBy("w").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = runs.drop("kept", "owner").join(first, "w").select("id", "h", "start", "end", (F.col("place") == F.col("first")).alias("kept"), F.col("first.id").alias("owner"))
        spans = spans.unionByName(parts.where("w IS NULL").drop("w")).unionByName(met)
    return spans


def merged(spans: DataFrame) -> DataFrame:
    """(id, h, start, end): overlapping and touching ranges of a document joined."""
    own = Window.partitionBy("id", "h").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("id", "h", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(own))
    return islands.groupBy("id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with a repeated passage: its spans (words start to end), those that repeat an earlier place, and documents with the earlier places."""
    spans = stage(repeats(df, key, text), "suffix-spans")
    all_of = _listed(merged(spans), "spans", "repeated_words")
    gone = _listed(merged(spans.where("NOT kept")), "removed", "removed_words")
    owners = spans.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("owner")))).alias("owners"))
    got = all_of.join(owners, ["id", "h"]).join(gone, ["id", "h"], "left")
    none = F.array().cast(gone.schema["removed"].dataType)
    return got.select(F.col("id").alias(key), F.size("spans").alias("n_spans"), "repeated_words", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "spans", F.coalesce("removed", none).alias("removed"), "owners")


def _listed(spans: DataFrame, name: str, words: str) -> DataFrame:
    return spans.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name), F.sum(F.col("end") - F.col("start")).cast("long").alias(words))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with every passage kept at its first place only; documents of which nothing is left go. n_chars, where df has it, is that of the new text."""
    gone = _listed(merged(repeats(df, key, text).where("NOT kept")), "__gone", "__n").select(F.struct("id", "h").alias("__key"), "__gone")
    rows = df.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("__key"), F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"))
    both = rows.join(gone, "__key", "left")
    words = F.regexp_extract_all("__text", F.lit(f"(?:{GAPS})?{WORD}"), F.lit(0))
    ends = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda x: x["end"]))
    pieces = lambda w: F.transform(F.arrays_zip(ends.alias("a"), F.concat(F.transform("__gone", lambda x: x["start"]), F.array(F.size(w))).alias("b")), lambda x: F.slice(w, x["a"] + 1, x["b"] - x["a"]))
    # the words are bound to a lambda's variable, so a text is split once
    kept = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(pieces(w)), "")), F.lit(0))
    new = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept)
    got = both.select("__row", "__gone", new.alias("__new")).where(F.col("__gone").isNull() | (F.length("__new") > 0))
    fresh = {text: F.col("__new"), "n_chars": F.when(F.col("__gone").isNull(), F.col("__row")["n_chars"]).otherwise(F.length("__new").cast("long")) if "n_chars" in df.columns else None}
    return got.select(*((F.col("__row")[c] if fresh.get(c) is None else fresh[c]).alias(c) for c in df.columns))
