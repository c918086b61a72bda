"""The pipeline's stages: what each must keep and drop."""

import random
import re

import corpus_pipeline as P

from ecotone.llm import bpe, queries, simhash, suffixes, toxicity  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def exact_groups(texts):
    """The smallest id reachable over pairs with a Jaccard likeness of 0.8 of their five-word shingles; texts without words stand alone."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    order = sorted(texts)
    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = len(sets[i]), len(sets[j])
            if words[i] and words[j] and min(a, b) >= 0.8 * max(a, b) and top(i) != top(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in texts}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.judged(before, labels).where("predicted = 1").collect()}
    assert ids(before) - ids(after) == rejected
    before, after = kept["simhash"]
    assert ids(after) == set(exact_groups({r["doc_id"]: r["text"] for r in before.collect()}).values()) and after.count() == len(ids(after))
    before, after = kept["passages"]
    assert suffixes.passages(after).count() == 0 or suffixes.passages(after).agg({"repeated_words": "sum"}).head()[0] < 0.01 * sum(len(WORDS.findall(r["text"])) for r in before.collect())
    clean = ids(before) - ids(suffixes.passages(before))
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(texts[r["doc_id"]] == r["text"] for r in before.collect() if r["doc_id"] in clean)
    before, after = kept["mixing"]
    whole = {r["doc_id"]: len(WORDS.findall(r["text"])) for r in before.collect()}
    took = {}
    for r in after.collect():
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + len(WORDS.findall(r["text"]))
    assert all(took[i] <= 3 * whole[i] for i in took)
    before, after = kept["bpe"]
    want = bpe.round_trip(before, *queries.tokenizer()).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, after.collect()))
    assert after.count() == before.count()


def test_simhash_stage_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "VERIFIED", 4)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = ["Two words", "two  WORDS", "two other", "", None, " "]
    for _ in range(8):
        base = [word() for _ in range(200)]
        texts += [" ".join(base)] * 2
        for edits in (1, 2, 3, 4, 4, 5, 6, 12):
            texts.append(" ".join(word() if k % (200 // edits) == 9 and k // (200 // edits) < edits else w for k, w in enumerate(base)))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.simhash_stage(spark, df, sf_dir).collect()} == set(exact_groups(dict(enumerate(texts))).values())


def test_simhash_stage_goes_through_fingerprints(spark, sf_dir, monkeypatch):
    """Copies with few edits meet only in the probes of SimHash fingerprints that the plans of thresholds give."""
    rnd = random.Random(9)
    base = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(200)]
    texts = [" ".join(base), " ".join([*base[:150], "edited", *base[151:]]), " ".join(reversed(base))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda: {r["doc_id"] for r in P.simhash_stage(spark, df, sf_dir).collect()}
    plans, plan = [], simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    assert left() == {0, 2}
    assert plans and all(sum(t + 1 for _, t in p) == simhash.forms(3)[0] + 1 for p in plans)
    monkeypatch.setattr(simhash, "probes", lambda probing: [(0, -1)])
    assert left() == {0, 1, 2}  # whole fingerprints as the only probes: just what no bit tells apart meets


def test_fingerprints_meet_at_the_likeness():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (200, 205_000, 1_000_000):
        distance, count = simhash.forms(n)
        widths = [(64 + k) // (distance + 1) for k in range(distance + 1)]
        starts = np.cumsum([0, *widths])
        for size, both in ((4, 4), (9, 8), (90, 80), (450, 400)):  # a likeness of 0.8: of 4 and 5, else of equal sizes
            for _ in range(100):
                own = rng.integers(0, 1 << 64, 2 * size + 1, dtype=np.uint64)
                x, y = own[:size], np.concatenate([own[:both], own[size : 2 * size - both + (size == both)]])
                a, b = (simhash.set_prints(s, count) for s in (x, y))
                bits = np.unpackbits((a ^ b).astype(">i8").view(np.uint8)).reshape(count, 64)
                assert (~np.add.reduceat(bits, starts[:-1], axis=1).astype(bool)).any()
                assert bits[:2].sum() <= simhash.FIRST and bits[: simhash.TESTED].sum() <= simhash.NEAR
            assert all(int(a[0]) >> k & 1 == (2 * sum(int(h) >> k & 1 for h in x) > len(x)) for k in range(63))


def test_simhash_stage_keeps_every_text(spark, sf_dir):
    rnd = random.Random(5)
    x, y, z = (" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(3))
    rows = [(3, y), (5, x), (5, y), (5, x), (None, z), (None, z), (None, y), (9, z + " end"), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.simhash_stage(spark, df, sf_dir).select("doc_id", "text").collect()
    assert sorted((str(i), str(t)) for i, t in got) == sorted((str(i), str(t)) for i, t in [(3, y), (5, x), (9, z + " end"), (4, None), (4, None)])


def test_run_registers():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is P.run
    assert [f"op{n}_" for n in range(1, 11)] == [next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))[: len(f"op{n}_")] for n in range(1, 11)]
