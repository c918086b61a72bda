"""Embedding near-duplicates: product quantisation over coarse inverted lists, exact cosine rerank.

Equal vectors of a label are one row from the start.  Each distinct vector,
scaled to length one, stands in the list of its nearest centroid, with its
residual coded in subspaces and the coding error kept.  A vector visits every
list whose cell comes within half the link distance of it: of two linked
vectors at least one lies that close to the plane between their lists, so no
link is lost, and a link that both find counts in one list.  In a list a table
lookup gives a vector's distance to each code, and whatever is within the link
distance plus the code's error is compared exactly in double precision.  Lists are cut to bounded cells; a cell gives a count of
links per vector and a spanning forest of its links.

Rows link only with equal labels and equal vector lengths.  Null labels, null,
empty or zero vectors and vectors with null or non-finite components link with
nothing and stand alone.  Repeated rows link with each other like any equal
vectors; a repeated id counts once for each row.  Links run between numbers of
distinct vectors, and only at the end the smallest id names a component: a null
id names none, a component of null ids alone has the id null, and all of it is
kept.  Centroids and codebooks are
fitted on at most `sample` vectors, whose choice a hash of the vector fixes; every
vector is indexed, and the fit affects only the speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.llm.shared import block_cells, components, forest, stage, stream_groups

#: Vectors that centroids and codebooks are fitted on.
SAMPLE = 8192
SUBSPACES = 8
CODES = 256
BLOCK = 768
#: Vectors of a list, on average over all labels.
LISTED = 400
#: For rounding in the test of reach.
SLACK = 1e-9


def _kmeans(x, k: int, rounds: int = 12):
    """Centroids by Lloyd's rounds from evenly spaced rows; an empty one keeps its place."""
    import numpy as np

    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(sample, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> tuple:
    """(centroids, codebooks) from unit vectors, one a row; each codebook covers a slice of the residual."""
    import numpy as np

    centroids = _kmeans(sample, lists)
    near = (-2 * sample @ centroids.T + (centroids * centroids).sum(axis=1)).argmin(axis=1)
    rest = sample - centroids[near]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    return centroids, [(a, b, _kmeans(rest[:, a:b], codes)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unit(rows, size: int):
    """Rows of one vector each, padded to `size` and scaled to length one, in double precision."""
    import numpy as np

    out = np.zeros((len(rows), size))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def valid(vector):
    """Whether a vector column can link at all."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(distinct: DataFrame, centroids, books, size: int, distance: float) -> DataFrame:
    """(rep, label, dims, n, list, home, code, err, embedding): each vector in its own list and as a visitor of the lists within reach."""
    model = distinct.sparkSession.sparkContext.broadcast((centroids, books))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centroids, books = model.value
        square = (centroids * centroids).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centroids @ centroids.T, 1e-18))
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = _unit(batch.column("embedding").to_pylist(), size)
                d = np.maximum(1 + square - 2 * x @ centroids.T, 0)
                own = d.argmin(axis=1)
                at = np.arange(len(x))
                rest = x - centroids[own]
                code = np.empty((len(x), len(books)), dtype=np.uint8)
                err = np.zeros(len(x))
                for s, (a, b, book) in enumerate(books):
                    code[:, s] = (-2 * rest[:, a:b] @ book.T + (book * book).sum(axis=1)).argmin(axis=1)
                    err += ((rest[:, a:b] - book[code[:, s]]) ** 2).sum(axis=1)
                reach = (d - d[at, own][:, None]) / (2 * apart[own]) <= distance / 2 + SLACK
                reach[at, own] = True
                r, c = np.nonzero(reach)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(take) for n in ("rep", "label", "dims", "n")), pa.array(c, pa.int32()), pa.array(own[r], pa.int32()), pa.array([bytes(v) for v in code[r]], pa.binary()), pa.array(np.sqrt(err)[r]), batch.column("embedding").take(take)],
                    ["rep", "label", "dims", "n", "list", "home", "code", "err", "embedding"],
                )

    kind, label = distinct.schema["embedding"].dataType.simpleString(), distinct.schema["label"].dataType.simpleString()
    return distinct.select("rep", "label", "dims", "n", "embedding").mapInArrow(run, f"rep long, label {label}, dims int, n long, list int, home int, code binary, err double, embedding {kind}")


def search(cells: DataFrame, centroids, books, size: int, cosine: float) -> DataFrame:
    """(u, v, n): with v null, n links of u in a cell; else a link (u, v) of a cell's spanning forest."""
    model = cells.sparkSession.sparkContext.broadcast((centroids, books))
    distance = (2 - 2 * cosine) ** 0.5
    keys = ["label", "dims", "list", "_i", "_j"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centroids, books = model.value
        for group in stream_groups(batches, keys):
            rep, n, home, k, err = (group.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "home", "_k", "err"))
            i, j, here = (group.column(c)[0].as_py() for c in ("_i", "_j", "list"))
            code = np.frombuffer(b"".join(group.column("code").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
            raw = _unit(group.column("embedding").to_pylist(), size)
            x = raw - centroids[here]
            count = np.zeros(len(rep), dtype=np.int64)
            us, vs = [], []
            for p, q in {(i, j), (j, i)}:
                ask, has = np.flatnonzero(k == p), np.flatnonzero((k == q) & (home == here))
                for s in range(0, len(ask) if len(has) else 0, 128):
                    a = ask[s : s + 128]
                    far = np.zeros((len(a), len(has)))
                    for m, (lo, hi, book) in enumerate(books):
                        table = (x[a, lo:hi] ** 2).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * x[a, lo:hi] @ book.T
                        far += table[:, code[has, m]]
                    near = np.maximum(far, 0) <= ((distance + err[has]) ** 2 + SLACK)[None, :]
                    near &= rep[a][:, None] != rep[has][None, :]
                    r, c = np.nonzero(near)
                    for t in range(0, len(r), 32768):
                        y, z = a[r[t : t + 32768]], has[c[t : t + 32768]]
                        hit = np.einsum("ij,ij->i", raw[y], raw[z]) >= cosine
                        y, z = y[hit], z[hit]
                        guest = home[y] != here
                        # z also found y as a guest of y's list: the list of the smaller number counts the link
                        theirs = centroids[home[y]]
                        gap = np.sqrt(np.maximum(((theirs - centroids[here]) ** 2).sum(axis=1), 1e-18))
                        away = ((raw[z] - theirs) ** 2).sum(axis=1) - (x[z] ** 2).sum(axis=1)
                        twice = guest & (away / (2 * gap) <= distance / 2 + SLACK) & (home[y] < here)
                        y, z, guest = y[~twice], z[~twice], guest[~twice]
                        np.add.at(count, y, n[z])
                        np.add.at(count, z[guest], n[y[guest]])
                        for u, v in forest(rep[y].tolist(), rep[z].tolist()):
                            us.append(u)
                            vs.append(v)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([*rep[some].tolist(), *us], pa.int64()), pa.array([None] * len(some) + vs, pa.int64()), pa.array([*count[some].tolist(), *[0] * len(us)], pa.int64())], ["u", "v", "n"])

    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u long, v long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    rows = rows.withColumn("fine", valid(F.col("embedding")) & F.col("label").isNotNull())
    fine = rows.where("fine")
    least = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # a number of its own for each distinct vector, fixed once the table is written
    distinct = stage(least.withColumns({"dims": F.size("embedding"), "rep": F.monotonically_increasing_id()}), "pq-distinct")
    drawn = distinct.select("embedding", "dims").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).collect()
    if drawn:
        facts = distinct.agg(F.max("dims").alias("size"), F.count(F.lit(1)).alias("n")).head()
        unit = _unit([r["embedding"] for r in drawn], facts["size"])
        lists = max(4, min(len(drawn) // 4, facts["n"] // LISTED))
        centroids, books = fit(unit, lists)
        cells = block_cells(index(distinct, centroids, books, facts["size"], (2 - 2 * cosine) ** 0.5), ["label", "dims", "list"], "rep", BLOCK)
        found = stage(search(cells, centroids, books, facts["size"], cosine), "pq-links")
        counts = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
        groups = components(found.where("v IS NOT NULL").select("u", "v"), "pq-cc").withColumnRenamed("id", "rep")
        per = distinct.join(counts, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        names = per.groupBy("component").agg(F.min("least").alias("component_id"))
        per = per.join(names, "component").select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        got = fine.join(per, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    else:
        got = fine.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(alone).select("vec_id", F.col("n_links").cast("long"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
