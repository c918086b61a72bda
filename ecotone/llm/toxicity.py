"""Toxicity: a factorisation machine over hashed terms.

A text's terms are its distinct lower-cased runs of letters, hashed to buckets.
The machine adds a weight for each bucket that a text holds and the inner
product of the buckets' factors for each pair, so it learns interactions that
additive weights miss.  The buckets that take part are those whose presence
goes with the label beyond chance, and those of pairs whose joint presence goes
with it beyond what the two do alone: a term that is no sign by itself, such as
a group's name, is there for the pair.  It is fitted on the driver on at most
`bound` labelled rows, whose choice a hash of the id fixes; labels, languages,
sources and ids are never inputs.

Null and empty texts hold no term and score the machine's constant.  Equal
texts score equally; repeated rows are scored each.  Rows whose label is null
are not learned from; several labels of one id count as the largest.  With no
labels at all every score is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.llm.shared import worker_cache

#: Buckets of the hash, factors of a bucket, and the labelled rows that the fit may take at most.
BUCKETS = 1 << 20
FACTORS = 8
BOUND = 12_000
#: A bucket takes part from this chi-square with the label, one degree of freedom, and this many rows.
CHI, LEAST_ROWS = 10.0, 5
#: So does each of a pair from this chi-square of its joint presence, of buckets in this share of the rows and so many rows with both.
PAIR_CHI, PAIR_SHARE, PAIR_ROWS = 40.0, 0.01, 20
#: Scores from which a text counts as toxic.
THRESHOLD = 0.7
SEED = 42
#: Terms that a worker remembers; memory only.
CACHE = 300_000


def _terms():
    import re

    return re.compile(r"[^\W\d_]+").findall


def _bucket(term: str) -> int:
    from zlib import crc32

    return crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def held_out(key) -> object:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _hashed(df: DataFrame) -> DataFrame:
    """(y, o, h, b) of rows (y, o, h, text): the text's buckets."""

    def run(batches):
        import pyarrow as pa

        find = _terms()
        for batch in batches:
            got = [sorted({_bucket(w) for w in set(find((t or "").lower()))}) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(got, pa.list_(pa.int32()))], ["y", "o", "h", "b"])

    return df.select("y", "o", "h", "text").mapInArrow(run, "y int, o long, h long, b array<int>")


class Machine:
    """sigmoid(w0 + sum of w + sum over pairs of the factors' inner products)."""

    def __init__(self, chosen, w0, w, v):
        self.at = {int(b): i for i, b in enumerate(chosen)}
        self.w0, self.w, self.v = float(w0), w, v

    def raw(self, hot) -> float:
        """The score before the sigmoid for a list of positions."""
        if not hot:
            return self.w0
        f = self.v[hot]
        s = f.sum(axis=0)
        return self.w0 + float(self.w[hot].sum()) + 0.5 * float((s * s).sum() - (f * f).sum())


def chosen(buckets, rows, y):
    """Which buckets take part, for the rows' buckets as numbers 0 .. n-1 one after the other and the row of each."""
    import numpy as np

    p, many = y.mean(), len(y)
    n, pos = np.bincount(buckets).astype(np.float64), np.bincount(buckets, y[rows])
    chi = (pos - n * p) ** 2 / np.maximum(n * p * (1 - p) * (1 - n / many), 1e-9)
    out = (n >= LEAST_ROWS) & (chi >= CHI)
    often = np.flatnonzero(n >= max(LEAST_ROWS, PAIR_SHARE * many))
    at = np.full(len(n), -1)
    at[often] = np.arange(len(often))
    inside = at[buckets] >= 0
    r, c = rows[inside], at[buckets[inside]]
    # what two signs that add up would give
    odds = lambda q: np.log(q / (1 - q))
    alone = odds((pos[often] + p) / (n[often] + 1))
    cuts = np.searchsorted(r, range(0, many + 500, 500))
    for start in range(0, len(often), 256):
        both, bad = (np.zeros((len(often), min(256, len(often) - start)), dtype=np.float32) for _ in range(2))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            x = np.zeros((min(500, many - 500 * k), len(often)), dtype=np.float32)
            x[r[a:b] - 500 * k, c[a:b]] = 1
            both += x.T @ x[:, start : start + 256]
            x = x[y[500 * k : 500 * k + len(x)] > 0]
            bad += x.T @ x[:, start : start + 256]
        e = 1 / (1 + np.exp(-(alone[:, None] + alone[None, start : start + 256] - odds(p))))
        chi = (bad - both * e) ** 2 / np.maximum(both * e * (1 - e), 1e-2)
        chi[both < PAIR_ROWS] = 0
        own = np.arange(both.shape[1])
        chi[own + start, own] = 0
        out[often] |= (chi >= PAIR_CHI).any(axis=1)
    return np.flatnonzero(out)


def fit(rows: list, **how) -> Machine:
    """Learn from (label, buckets) rows."""
    import numpy as np

    lens = np.array([len(r[1]) for r in rows], dtype=np.int64)
    return fit_arrays(np.array([r[0] for r in rows], dtype=np.float64), lens, np.array([b for r in rows for b in r[1]], dtype=np.int64), **how)


def fit_arrays(y, lens, buckets, rounds: int = 60, rate: float = 0.05, decay: float = 1e-4, lot: int = 256) -> Machine:
    """Adagrad on the log loss over labels and the rows' buckets one after the other, in lots whose order a seed fixes; sparse throughout."""
    import numpy as np

    if not len(y) or y.min() == y.max():
        rate0 = (y.sum() + 0.01) / (len(y) + 1) if len(y) else 0.0
        return Machine([], np.log(rate0 / (1 - rate0)) if len(y) else -np.inf, np.zeros(0), np.zeros((0, FACTORS)))
    every, buckets = np.unique(buckets, return_inverse=True)
    of = np.repeat(np.arange(len(y)), lens)
    keep = chosen(buckets, of, y) if len(every) else every
    at = np.full(len(every), -1)
    at[keep] = np.arange(len(keep))
    inside = at[buckets] >= 0
    of, x = of[inside], at[buckets[inside]]
    ends = np.searchsorted(of, range(len(y) + 1))
    random = np.random.default_rng(SEED)
    w0, w, v = np.log(y.mean() / (1 - y.mean())), np.zeros(len(keep)), random.normal(0, 0.05, (len(keep), FACTORS))
    seen0, seen_w, seen_v = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(rounds):
        order = random.permutation(len(y))
        for a in range(0, len(y), lot):
            some = order[a : a + lot]
            sizes = ends[some + 1] - ends[some]
            row = np.repeat(np.arange(len(some)), sizes)
            own, local = np.unique(np.concatenate([x[ends[i] : ends[i + 1]] for i in some]), return_inverse=True)
            f, full = v[own][local], np.flatnonzero(sizes)
            sums, rest = np.zeros((len(some), FACTORS)), np.zeros(len(some))
            if len(full):
                first = (np.cumsum(sizes) - sizes)[full]
                sums[full] = np.add.reduceat(f, first, axis=0)
                rest[full] = np.add.reduceat(w[own][local] - 0.5 * (f * f).sum(axis=1), first)
            g = 1 / (1 + np.exp(-np.clip(w0 + rest + 0.5 * (sums * sums).sum(axis=1), -30, 30))) - y[some]
            back = g[row]
            to_w = np.bincount(local, back, len(own)) / len(some) + decay * w[own]
            to_v = np.stack([np.bincount(local, back * (sums[row, k] - f[:, k]), len(own)) for k in range(FACTORS)], axis=1) / len(some) + decay * v[own]
            seen0 += g.mean() ** 2
            seen_w[own] += to_w**2
            seen_v[own] += to_v**2
            w0 -= rate * g.mean() / np.sqrt(seen0)
            w[own] -= rate * to_w / np.sqrt(seen_w[own])
            v[own] -= rate * to_v / np.sqrt(seen_v[own])
    return Machine(every[keep], w0, w, v)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = BOUND) -> Machine:
    """Learn from the labelled rows that are not held out: at most `bound`, which alone come to the driver, as bucket lists. Rows with equal id and text count once."""
    import pyarrow.compute as pc

    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("y"))
    marked = marked.where(~held_out("_id")).groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(marked), "_id")
    rows = _hashed(rows.select("y", F.xxhash64("_id").alias("o"), F.xxhash64("text").alias("h"), "text")).dropDuplicates(["o", "h"])
    got = rows.orderBy("o", "h").limit(bound).select("y", "b").toArrow().combine_chunks()
    lists = got.column("b").combine_chunks()
    return fit_arrays(got.column("y").to_numpy().astype("float64"), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64"), lists.flatten().to_numpy().astype("int64"))


def score(df: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """df with the machine's score, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in df.columns if c != into]
    schema = f"{df.select(*kept).schema.simpleString()[7:-1]}, `{into}`: double"

    def run(batches):
        from math import exp

        import pyarrow as pa

        machine, find = shared.value, _terms()
        seen = worker_cache("toxicity")
        if seen.get("") is not machine:
            seen.clear()
            seen[""] = machine
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)):
                hot = set()
                for w in set(find((t.as_py() or "").lower())):
                    if (i := seen.get(w)) is None:
                        if len(seen) > CACHE:
                            seen.clear()
                            seen[""] = machine
                        i = seen[w] = machine.at.get(_bucket(w), -1)
                    if i >= 0:
                        hot.add(i)
                z = machine.raw(sorted(hot))
                out.append(1 / (1 + exp(-z)) if z > -700 else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(out, pa.float64())], [*kept, into])

    return df.select(*kept).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted)."""
    got = score(docs.select(key, text), train(docs, labels, key, text, label), text)
    return got.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
