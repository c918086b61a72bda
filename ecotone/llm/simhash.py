"""SimHash near-duplicates: 64-bit fingerprints, generalised pigeonhole probes, verified links, components.

Equal fingerprints are one row from the start.  The 64 bits are grouped so that
correlated bits share a part; a dynamic programme gives each part a threshold
t >= -1 so that the sum of t + 1 over the parts is one more than the distance
wanted, at the least estimated cost.  Two fingerprints within that distance
agree in some part but for t bits (t = -1: the part is not probed).  Rows that
share a probe meet in bounded cells and are compared bit by bit there; only a
spanning forest of the links leaves a cell.

Null and empty texts have the fingerprint zero and are linked like any other.
Repeated rows have equal fingerprints.  Links run between fingerprints, which
are never null, and only at the end the smallest id names a component: a null
id names none, and a component of null ids alone has the id null.  Only the id
and text columns are read.

`near_copies` is for whole corpora: texts whose sets of five-word shingles have
a Jaccard likeness of 0.8 or more.  Such texts differ in about 10 of 64 bits,
too many for the probes of one fingerprint, so each set gets several independent
fingerprints (`forms`), each with its own plan of parts and thresholds.  Sets
within the plan's distance in any fingerprint always meet; those at the likeness
wanted, which are mostly farther apart, agree in some part of some fingerprint
but for a chance of MISS.  What meets is tested bit by bit, and each link is
verified on the whole sets of shingles.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, inf, log, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.llm.shared import WORD, block_cells, cell_forest, components, once, stage, stream_groups, worker_cache

SEED = 42
#: Bytes A-Z lower-cased.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at a time.
CHUNK = 100_000
#: Rows of a block; a cell holds two at most.
BLOCK = 1024
#: Of two sets at a likeness of 0.8 a fingerprint's bit differs with this chance at most: 0.152 (arccos(8/9)/pi) if they are large, 3/16 if they have 4 and 5 members.
APART = 3 / 16
#: The chance that two such sets meet in no probe.
MISS = 1e-5
#: Writing a probe's row costs as much as comparing so many pairs of them, and so does one fingerprint of a text.
ROW, PRINT = 1000, 6000
#: Sets that meet are compared in so many fingerprints, the first two before the rest, and differ in so many bits at most: five deviations over APART in the first two (mean 24), four in all (mean 60).
TESTED, FIRST, NEAR = 5, 46, 88
#: Texts of a block while links are verified.
VERIFIED = 256


def _hashes(text, width: int) -> bytes:
    """The XXH64 of each shingle of words, big-endian, one after the other."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])


def fingerprints_of(texts, width: int = 3):
    """int64 fingerprints: a bit is set if it is in over half of the shingles' hashes."""
    import numpy as np

    raw = [_hashes(t, width) for t in texts]
    n = np.array([len(r) // 8 for r in raw], dtype=np.int64)
    counts = np.zeros((len(raw), 64), dtype=np.int64)
    k = 0
    while k < len(raw):
        if n[k] > CHUNK:
            for a in range(0, len(raw[k]), 8 * CHUNK):
                part = np.frombuffer(raw[k][a : a + 8 * CHUNK], dtype=np.uint8).reshape(-1, 8)
                counts[k] += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            k += 1
            continue
        m, size = k, 0
        while m < len(raw) and n[m] <= CHUNK and size + n[m] <= CHUNK:
            size += n[m]
            m += 1
        own = np.flatnonzero(n[k:m]) + k
        if len(own):
            bits = np.unpackbits(np.frombuffer(b"".join(raw[k:m]), dtype=np.uint8).reshape(-1, 8), axis=1)
            counts[own] = np.add.reduceat(bits, np.cumsum(n[own]) - n[own], axis=0, dtype=np.int32)
        k = m
    return np.packbits(2 * counts > n[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each text as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        worker_cache("simhash")
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), width))], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def bit_statistics(rows: DataFrame, count: int) -> list:
    """(n, 64 x 64 counts of bits set together) for each of the `count` fingerprints in the array `prints`: each task sends one matrix a fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, n = np.zeros((count, 64, 64), dtype=np.int64), 0
        for batch in batches:
            prints = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(">i8").reshape(-1, count)
            for k in range(count):
                bits = np.unpackbits(np.ascontiguousarray(prints[:, k]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
                total[k] += (bits.T @ bits).astype(np.int64)
            n += len(prints)
        yield pa.RecordBatch.from_arrays([pa.array(range(64 * count + 1), pa.int32()), pa.array([*total.reshape(-1, 64).tolist(), [n] * 64], pa.list_(pa.int64()))], ["b", "c"])

    import numpy as np

    sums = rows.select("prints").mapInArrow(run, "b int, c array<long>").groupBy("b").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(64))).alias("c"))
    got = {r["b"]: r["c"] for r in sums.collect()}  # 64 rows a fingerprint, and one
    n = got[64 * count][0] if got else 0
    return [(n, np.array([got[64 * k + i] for i in range(64)], dtype=np.float64) if got else np.zeros((64, 64))) for k in range(count)]


def group_bits(n: int, together, parts: int) -> list:
    """Bits dealt to parts of nearly equal width, each bit to the part it is most correlated with."""
    import numpy as np

    p = together.diagonal() / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        width = (64 + k) // parts
        part = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            b = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            left.discard(b)
        out.append(sorted(part))
    return out


def estimated(n: int, together, part: list, t: int, row: int = 50) -> float:
    """Cost of probing a part with threshold t: rows written (each as dear as `row` pairs) and pairs compared, from how often each bit agrees."""
    if t < 0:
        return 0.0
    if t >= len(part):  # no bit is left to probe
        return inf
    p = together.diagonal()[part] / max(n, 1)
    chance = [1.0] + [0.0] * t  # of so many differing bits
    for agree in p * p + (1 - p) * (1 - p):
        chance = [c * agree + (chance[i - 1] * (1 - agree) if i else 0.0) for i, c in enumerate(chance)]
    return n * comb(len(part), t) * row + n * n / 2 * sum(chance) * comb(len(part), t)


def allocate(costs: list, distance: int) -> tuple:
    """(cost, thresholds): the least sum of costs[part][t + 1] over thresholds t with sum(t + 1) = distance + 1."""
    best: dict = {0: (0.0, ())}
    for part in costs:
        step: dict = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance - used + 1):
                got = (cost + part[t + 1], (*ts, t))
                step[used + t + 1] = min(step.get(used + t + 1, got), got)
        best = step
    return best[distance + 1]


def plan(n: int, together, distance: int = 2, numbers=range(1, 6), row: int = 50) -> list:
    """[(bits of the part, threshold)] of the cheapest grouping into one of these numbers of parts."""
    found = []
    for m in numbers:
        parts = group_bits(n, together, m)
        cost, ts = allocate([[estimated(n, together, part, t, row) for t in range(-1, distance + 1)] for part in parts], distance)
        found.append((cost, m, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(found)[2]


def probes(probing: list) -> list:
    """(probe number, bit mask): for threshold t a probe for each choice of t bits to leave out."""
    out = []
    for part, t in probing:
        for left_out in combinations(part, t):
            mask = sum(1 << (63 - b) for b in part if b not in left_out)
            out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return list(enumerate(out))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (u, v) that connect all distinct fingerprints (fp) within the distance, found by links in each cell."""
    n, together = bit_statistics(fps.select(F.array("fp").alias("prints")), 1)[0]
    masks = probes(plan(n, together, distance))
    tagged = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for i, m in masks))).alias("x")).select("fp", "x.p", "x.val")
    cells = block_cells(tagged, ["p", "val"], "fp", BLOCK)
    cells = cells.repartition("p", "val", "_i", "_j").sortWithinPartitions("p", "val", "_i", "_j", "fp").select("p", "val", "_i", "_j", "_k", "fp")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for group in stream_groups(batches, ["p", "val", "_i", "_j"]):
            fp, k = (group.column(c).to_numpy() for c in ("fp", "_k"))
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            def near(x, y, fp=fp):
                at, to = np.nonzero(np.bitwise_count((fp[x, None] ^ fp[y][None, :]).view(np.uint64)) <= distance)
                return x[at], y[to]

            got = cell_forest(np.flatnonzero(k == i), np.flatnonzero(k == j), i == j, near, fp, 256)
            if got:
                us, vs = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return cells.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2, width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key reachable over links between fingerprints."""
    prints = stage(fingerprints(df, key, text, width), "simhash-fp")
    reps = stage(prints.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-reps")
    found = components(links(reps, distance), "simhash-cc").withColumnRenamed("id", "fp")
    of = named(reps, found)
    return prints.join(of, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def named(reps: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id): the least `rep` of each component of fingerprints; those without a link stand alone."""
    whole = reps.select("fp", "rep").join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    return whole.join(least, "component").select("fp", "component_id")


def shingle_set(text, width: int = 5):
    """The sorted distinct shingle hashes of a text."""
    import numpy as np

    return np.unique(np.frombuffer(_hashes(text, width), dtype=">u8").astype(np.uint64))


def set_hash(shingles) -> int:
    """A signed long for a set of shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def forms(n: int) -> tuple:
    """(distance, number of fingerprints): the cheapest for n sets with which two sets at the likeness wanted meet but for MISS.

    At a distance of d a fingerprint has d + 1 parts, so a small distance means
    wide parts, which seldom agree by chance, and many fingerprints; the more
    sets, the wider the parts.
    """
    found = []
    for distance in range(2, 9):
        parts, width = distance + 1, 64 / (distance + 1)
        count = max(TESTED, ceil(log(MISS) / (parts * log1p(-((1 - APART) ** width)))))
        met = n / 2**width
        found.append((count * (PRINT + parts * (ROW * max(1.0, met / BLOCK) + met / 2)), distance, count))
    return min(found)[1:]


def set_prints(shingles, count: int):
    """int64 SimHash fingerprints of a set of hashes: the first from the hashes' own bits, each other from a mixing of them."""
    import numpy as np

    ones = np.zeros(64 * count, dtype=np.int64)
    for a in range(0, len(shingles), 255):  # sums of 255 bits fit a byte
        h = shingles[a : a + 255, None] + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h[:, 0] = shingles[a : a + 255]
        ones += np.unpackbits(h.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).view(">i8").astype(np.int64)


def sketches(rows: DataFrame, width: int, count: int) -> DataFrame:
    """(id, h, fp, prints) of rows (id, h, text): the hash of each text's set and the set's `count` fingerprints."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_cache("simhash")
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = [shingle_set(t.as_py(), width) for t in part.column(2)]
                prints = pa.array([set_prints(x, count) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([set_hash(x) for x in sets], pa.int64()), prints], ["id", "h", "fp", "prints"])

    return rows.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, fp long, prints array<long>")


def candidates(reps: DataFrame, distance: int, count: int) -> DataFrame:
    """Pairs (u, v) that connect all sets (fp, prints) which share a probe of some fingerprint and look alike: a spanning forest of each cell, by least members."""
    keys = ["p", "val", "_i", "_j"]
    masks = [(k, m) for k, (n, together) in enumerate(bit_statistics(reps, count)) for _, m in probes(plan(n, together, distance, [distance + 1], ROW))]
    probed = F.array(*(F.struct(F.lit(p).alias("p"), F.col("prints")[k].bitwiseAND(F.lit(m)).alias("val")) for p, (k, m) in enumerate(masks)))
    cells = block_cells(reps.select("fp", F.slice("prints", 1, TESTED).alias("sig"), F.explode(probed).alias("x")).select("fp", "sig", "x.p", "x.val"), ["p", "val"], "fp", BLOCK)
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "_k", "fp", "sig")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for group in stream_groups(batches, keys):
            fp, k = (group.column(c).to_numpy() for c in ("fp", "_k"))
            sig = group.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(fp), TESTED).view(np.uint64)
            one, two = (np.ascontiguousarray(sig[:, c]) for c in (0, 1))
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            def near(x, y, sig=sig, one=one, two=two):
                apart = np.bitwise_count(one[x, None] ^ one[y][None, :])
                apart += np.bitwise_count(two[x, None] ^ two[y][None, :])
                at, to = np.nonzero(apart <= FIRST)
                x, y = x[at], y[to]
                like = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64) <= NEAR
                return x[like], y[like]

            got = cell_forest(np.flatnonzero(k == i), np.flatnonzero(k == j), i == j, near, fp)
            if got:
                us, vs = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return stars(cells.mapInArrow(run, "u long, v long"))


def stars(found: DataFrame) -> DataFrame:
    """Pairs (u, v) that connect what those found do (u > v): each u keeps its least v, and its other v hang on that one, so a group met in many cells is mostly one star.

    A u has a v for each of its cells at most.
    """
    of = found.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("v", F.array_min("vs"))
    return of.select(F.explode(F.array_union(F.array("u"), F.array_except("vs", F.array("v")))).alias("u"), "v")


def verified(sets: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (u, v) that connect all sets (fp, component, shingles) of a component with the likeness: what is connected already is passed over."""
    keys = ["component", "_i", "_j"]
    cells = block_cells(sets, ["component"], "fp", VERIFIED)
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "fp").select(*keys, "_k", "fp", "shingles")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for group in stream_groups(batches, keys):
            fp, k = (group.column(c).to_numpy() for c in ("fp", "_k"))
            own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("shingles")]
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            parent = np.arange(len(fp))

            def joined(p, q, inside, own=own, parent=parent, fp=fp):
                """Links that connect rows of p and q which were not connected, between the least rows of what they connect."""
                out = []
                for x in p:
                    for y in q[parent[q] != parent[x]].tolist():
                        n, m = len(own[x]), len(own[y])
                        if (inside and y <= x) or parent[x] == parent[y] or min(n, m) < jaccard * max(n, m) - 1e-9:
                            continue
                        both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                        if both >= jaccard * (n + m - both) - 1e-9:
                            least, most = sorted((int(parent[x]), int(parent[y])))
                            parent[parent == most] = least
                            out.append((int(fp[most]), int(fp[least])))
                return out

            a, b = np.flatnonzero(k == i), np.flatnonzero(k == j)
            got = joined(a, a, True)
            if i != j:  # what is connected inside either block its own cell tells
                joined(b, b, True)
                got = joined(a, b, False)
            if got:
                us, vs = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return cells.mapInArrow(run, "u long, v long")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, jaccard: float = 0.8) -> DataFrame:
    """(id, h, component_id, kept): the smallest id reachable over pairs of texts whose sets of shingles have the likeness.

    h is the text's hash (of an empty text for null): rows with equal id and
    text are one row here, rows that share only the id are apart.  One row of
    each component is kept: that of the smallest (id, h), null ids last.  A
    component of null ids alone has the id null.  Texts without words have
    equal, empty sets.
    """
    rows = df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    distance, count = forms(rows.count())
    prints = stage(sketches(rows, width, count), "copies-sketches")
    own = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    reps = stage(prints.groupBy("fp").agg(F.min(own).alias("rep"), F.any_value("prints").alias("prints")), "copies-reps")
    maybe = components(candidates(reps, distance, count), "copies-maybe").withColumnRenamed("id", "fp")
    asked = reps.join(maybe, "fp").select(F.col("rep.id").alias("_id"), F.col("rep.h").alias("_h"), "fp", "component")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = [shingle_set(t.as_py(), width).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["fp", "component", "shingles"])

    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("fp", "component", "text")
    sets = stage(texts.mapInArrow(run, "fp long, component long, shingles binary").dropDuplicates(["fp"]), "copies-sets")
    of = named(reps, components(verified(sets, jaccard), "copies-cc").withColumnRenamed("id", "fp"))
    every = prints.groupBy("id", "h").agg(F.any_value("fp").alias("fp")).join(of, "fp")
    return every.select("id", "h", F.col("component_id.id").alias("component_id"), own.eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, jaccard: float = 0.8) -> DataFrame:
    """df with one row of each group of near copies; rows whose text has no word all stay."""
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    own = F.struct(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    some = once(df.where(worded).withColumn("__key", own), ["__key"])
    kept = near_copies(some, key, text, width, jaccard).where("kept").select(F.struct("id", "h").alias("__key"))
    return some.join(stage(kept, "copies-kept"), "__key", "left_semi").select(*df.columns).unionByName(df.where(~worded))
