"""The training-data operators against brute force, round trips and odd tables."""

import hashlib
import random
import re
from collections import defaultdict
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from ecotone.llm import bpe, chat, fingerprint, licenses, mixing, queries, shared, simhash, suffixes, toxicity, urls, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["an", "th", "er", "on", "re", "he"]) for _ in range(rnd.randint(1, 5))) for _ in range(n))


ODD = [None, "", " ", "\n\t ", "one", "one two", "one two three", "Été 日本語 🙂", "x" * 5000, "a b " * 3000, "one two", "a\x00b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    df = docs(spark, ODD).unionByName(spark.createDataFrame([(None, "null id", None, None, None), (3, "\n\t ", "en", "s0", 3), (3, "\n\t ", "en", "s0", 3)], DOCS))
    return df.withColumns({c: F.lit(7) for c in ("h", "fp", "rep", "id", "s", "start", "n", "w", "sketch", "score", "ids", "size", "g", "pos", "u", "v", "_i", "edge")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer()


def test_bpe_equals_the_library(spark, tokenizer):
    import tiktoken

    ranks, pattern = tokenizer
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "  a  b \n\n c", "x\n y", "foo  ", " foo", "a" * 700 + " " + "ab" * 400, "日本語のテキスト" * 60, "a  b\x1c c \x85d\xa0 e", "it's we'll 123 45,6 !!! \t\t x", "é" * 500, "<|endoftext|> x", "\ufeff a", "a   b    c", "".join(map(chr, range(1, 3000))), prose(random.Random(1), 3000)]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in bpe.round_trip(df, ranks, pattern).collect()}
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df.withColumn("ids", F.lit("clash")), ranks, pattern).collect()}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(df, ranks, pattern), ranks, pattern).collect()}
    for i, t in enumerate(texts):
        want = own.encode_ordinary(t)
        assert ids[i] == want and back[i].decode() == t
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd(odd, none, tokenizer):
    got = bpe.round_trip(odd, *tokenizer).collect()
    assert len(got) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] in (0, 1)} == {(0, empty, empty)}
    assert bpe.round_trip(none, *tokenizer).count() == 0


def test_bpe_cache_may_turn_over(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "CACHE", 5)
    codec = bpe.Codec(*tokenizer)
    texts = [prose(random.Random(i), 30) + ",\n x" for i in range(20)]
    fresh = [codec.encode([t])[0] for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 10**6)
    assert bpe.Codec(*tokenizer).encode(texts) == fresh


def test_bpe_heap_and_recursion_agree_for_any_ranks(monkeypatch):
    """Also where a token ranks below its parts, so that a contraction may make a pair of less rank."""
    import tiktoken

    rnd = random.Random(41)
    ranks = {bytes([b]): b for b in range(256)}
    more = set()
    while len(more) < 400:
        more.add(bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(2, 5))))
    more = sorted(more)
    rnd.shuffle(more)
    ranks |= {t: 256 + i for i, t in enumerate(more)}
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 80))) for _ in range(200)] + ["a" * 301, "ab" * 200]
    for long in (1, 10**6):
        monkeypatch.setattr(bpe, "LONG", long)
        got = bpe.Codec(ranks, r"\S+|\s+").encode(texts)
        assert [[int(i) for i in g[0].split()] for g in got] == [own.encode_ordinary(t) for t in texts]
        assert [g[1].decode() for g in got] == texts


def test_bpe_of_a_word_of_a_million_letters(tokenizer):
    import time

    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", k=1_000_000))
    began = time.time()
    ids, back = bpe.Codec(*tokenizer).encode([text])[0]
    assert back.decode() == text and ids.count(b" ") > 100_000 and time.time() - began < 60


def test_bpe_decodes_tokens_by_the_vocabulary(tokenizer):
    ranks, pattern = tokenizer
    codec = bpe.Codec(ranks, pattern)
    codec.con.execute("UPDATE vocab SET v = replace(v, s, '?') WHERE id = ?", [ranks[b" the"]])
    assert codec.encode(["of the"])[0][1] == b"of?"


# 2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.7 * sum(r["toxic"] for r in got)
    assert hit >= 0.98 * sum(r["predicted"] for r in got)
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.96


@pytest.mark.parametrize("label", [lambda a, b: a and b, lambda a, b: a != b, lambda a, b: a == b])
def test_toxicity_learns_a_pair(label):
    """Labels that only the pair tells: in the last two neither term goes with the label by itself."""
    rnd = random.Random(3)
    words = [toxicity._bucket(w) for w in ("insult", "group")]
    noise = [toxicity._bucket(f"w{i}") for i in range(300)]
    rows = [(int(label(a, b)), sorted({*rnd.sample(noise, 10), *(w for w, on in zip(words, (a, b)) if on)})) for _ in range(4000) for a, b in [(rnd.random() < 0.5, rnd.random() < 0.5)]]
    m = toxicity.fit(rows)
    assert set(words) <= set(m.at)
    for a in (False, True):
        for b in (False, True):
            z = m.raw([m.at[w] for w, on in zip(words, (a, b)) if on])
            assert z > 0.5 if label(a, b) else z < -0.5


def test_toxicity_score_is_the_sum_over_pairs(spark):
    import numpy as np

    g = np.random.default_rng(1)
    terms = ["alpha", "beta", "gamma", "delta"]
    at = sorted(toxicity._bucket(t) for t in terms)
    m = toxicity.Machine(at, 0.3, g.normal(size=4), g.normal(size=(4, toxicity.FACTORS)))
    texts = ["", None, "alpha", "Alpha beta-GAMMA alpha", "delta gamma beta alpha x", "nothing known"]
    for r in toxicity.score(docs(spark, texts), m).collect():
        hot = [at.index(toxicity._bucket(t)) for t in terms if t in (r["text"] or "").lower()]
        z = 0.3 + sum(m.w[i] for i in hot) + sum(m.v[i] @ m.v[j] for k, i in enumerate(hot) for j in hot[:k])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_toxicity_bounds_rows_of_one_id(spark):
    rows = [(0, f"text {i}") for i in range(500)] + [(2, "other")] * 300 + [(i, f"word{i % 7}") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit_arrays = toxicity.fit_arrays, lambda y, lens, buckets: seen.extend(y) or fit(y, lens, buckets)
    try:
        toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, bound=100)
    finally:
        toxicity.fit_arrays = fit
    assert len(seen) == 100


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 1, None), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(odd, labels).count() == odd.count()
    assert toxicity.judged(none, labels).count() == 0
    got = toxicity.judged(odd, labels.where("false")).collect()
    assert {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0}
    same = defaultdict(set)
    for r in toxicity.score(odd, toxicity.train(odd, labels)).collect():
        same[r["text"]].add(r["score"])
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in same.values())


# 3


def test_automaton_against_globs():
    rnd = random.Random(5)
    globs = ["*", "", "a*b", "*ab*", "?b", "a?*c", "**a**", "abc", *("".join(rnd.choice("ab*?") for _ in range(rnd.randint(1, 30))) for _ in range(60))]
    texts = ["", "a", "b", "ab", "abc", *("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(300))]
    hit = urls.Automaton(globs).matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert [bool(x) for x in hit[i]] == [fnmatchcase(t, g) for g in globs], t


def test_url_rules(spark, none):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "HTTP://WWW.Example.NET/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"), "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"), "http://x.example.com/de/#a": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://": ("", "", None, "allow"), "http://my-casino.de/": ("my-casino.de", "/", None, "block"),
        "a://b?c://d.net/": ("b", "", None, "allow"), "http://É.net/É": ("É.net", "/É", "net/", "block"), "http://a.net/" + "y" * 20_000: ("a.net", "/" + "y" * 20_000, "net/", "block"),
    }
    rows = [(i, u, 1, 2) for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int, rule int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == cases
    assert urls.judge(df.where("false")).count() == 0


def test_default_globs(spark):
    cases = {"https://ads.shop.de/x": "block", "http://shop.de/ads/1": "block", "http://shop.de/a/photo.jpg": "block", "http://shop.de/a/photo.jpg/about": "allow", "http://pads.shop.de/loads/": "allow", "http://192.168.0.1/": "block", "http://x.bet/": "block", "http://alphabet.de/": "allow", "http://a.de/login": "block", "http://a.de/logins": "allow"}
    got = {r["url"]: r["verdict"] for r in urls.judge(spark.createDataFrame([(u,) for u in cases], "url string")).collect()}
    assert got == cases
    machine = urls.Automaton(urls.BLOCK_GLOBS)
    assert machine.words > 4
    texts = [f".{u.split('://')[1].split('/')[0]}#/{u.split('://')[1].partition('/')[2]}" for u in cases]
    assert [any(row) for row in machine.matches([t.encode() for t in texts])] == [any(fnmatchcase(t, g) for g in urls.BLOCK_GLOBS) for t in texts]


# 4


def covered(texts, length=suffixes.LENGTH):
    """(words in a stretch that stands twice, words in a stretch that stands at an earlier place too) by document."""
    seen = defaultdict(list)
    for i, w in enumerate(WORDS.findall(t or "") for t in texts):
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])].append((i, k))
    twice, later = defaultdict(set), defaultdict(set)
    for at in seen.values():
        for n, (i, k) in enumerate(at if len(at) > 1 else []):
            twice[i].update(range(k, k + length))
            if n:
                later[i].update(range(k, k + length))
    return twice, later


def spanned(spans):
    return {w for s in spans for w in range(s["start"], s["end"])}


@pytest.mark.parametrize("hot", [8, 10**6])
def test_passages_against_brute_force(spark, monkeypatch, hot):
    rnd = random.Random(7)
    shared_parts = [prose(rnd, n) for n in (50, 51, 60, 75, 140, 49)]
    texts = [prose(rnd, rnd.randint(0, 200)) + " " + "\n ".join(rnd.sample(shared_parts, rnd.randint(0, 2))) + "  " + prose(rnd, rnd.randint(0, 60)) for _ in range(60)]
    texts += [texts[3], texts[3], shared_parts[0], prose(rnd, 120), "same line again and again " * 40]
    # stretches of one long text, each with its own ends: matches that are no neighbours in any one order
    long = prose(rnd, 400).split(" ")
    for _ in range(60):
        a = rnd.randint(0, 340)
        texts.append(" ".join([*prose(rnd, rnd.randint(0, 9)).split(" "), *long[a : a + rnd.randint(40, 120)], *prose(rnd, rnd.randint(0, 9)).split(" ")]))
    # many ranges and small batches, so that groups cross their ends
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 40)
    monkeypatch.setattr(suffixes, "HOT", hot)
    df = docs(spark, texts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        got = {r["doc_id"]: r for r in suffixes.passages(df).collect()}
        left = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    twice, later = covered(texts)
    assert {i: spanned(r["spans"]) for i, r in got.items()} == twice
    assert {i: spanned(r["removed"]) for i, r in got.items() if r["removed"]} == later
    assert all(r["repeated_words"] == len(twice[i]) and r["removed_words"] == len(later[i]) for i, r in got.items())
    for i, t in enumerate(texts):
        kept = [w for k, w in enumerate(WORDS.findall(t)) if k not in later[i]]
        assert WORDS.findall(left.get(i, "")) == kept
        assert later[i] or left[i] == t
    for part in shared_parts[:5]:  # each passage stays somewhere
        assert any(part in " ".join(WORDS.findall(t)) for t in left.values())


def test_passages_of_repeated_rows(spark):
    rnd = random.Random(9)
    part = prose(rnd, 80)
    rows = [(1, part), (1, part), (1, "own " + part), (None, part + " end"), (None, part + " end"), (7, prose(rnd, 90))]
    left = sorted((str(r["doc_id"]), r["text"]) for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # one of the two texts of id 1 has the smaller hash and keeps the passage, in both its rows if there are two
    assert [r for r in left if r[0] == "None"] == [("None", " end")] * 2 and ("7", rows[5][1]) in left
    assert sorted(t.strip() for i, t in left if i == "1") in (["own", part, part], ["own " + part])


def test_passages_odd(odd, none):
    got = suffixes.passages(odd).collect()
    assert {r["doc_id"] for r in got} == {9}  # "a b a b ..." repeats itself
    back = suffixes.without_repeats(odd)
    assert back.columns == odd.columns
    assert back.count() == odd.count()
    assert suffixes.passages(none).count() == 0 and suffixes.without_repeats(none).count() == 0


# 5


def test_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 20)  # many cells
    monkeypatch.setattr(vectors, "LISTED", 15)
    g = np.random.default_rng(4)
    base = g.normal(size=(120, 16))
    rows = [base[i % 120] + g.normal(size=16) * (0.04 if i % 3 else 0) for i in range(360)]
    table = [(i, [float(np.float32(v)) for v in x], i % 2) for i, x in enumerate(rows)]
    table += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0] * 16, None), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(table)
    fine = {i: (np.array(x, dtype=float), lab) for i, x, lab in table if i < 1000 or i in (1006, 1007)}
    links = {i: [j for j, (y, m) in fine.items() if j != i and m == lab and len(y) == len(x) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98] for i, (x, lab) in fine.items()}
    for i in got:
        assert got[i]["n_links"] == len(links.get(i, [])), i
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_null_and_large_ids(spark):
    big = 2**53 + 1
    rows = [(None, [1.0, 0.0], 0), (big + 2, [1.0, 0.01], 0), (big, [1.0, 0.02], 0), (None, [0.0, 1.0], 0), (5, [-1.0, 0.0], 0), (5, [0.0, -1.0], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == sorted([(0, 2, big, False), (big + 2, 2, big, False), (big, 2, big, True), (0, 0, 0, True), (5, 0, 5, True), (5, 0, 5, True)])


# 6


def brute_fingerprint(text):
    import xxhash

    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "CHUNK", 500)
    rnd = random.Random(11)
    long = prose(rnd, 700)
    texts = [*ODD, long, *(f"{long} {prose(rnd, k)}" for k in range(30)), *(prose(rnd, 90) for _ in range(40)), *(["copy of a text"] * 9)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    for i, p in enumerate(prints):
        assert got[i]["fingerprint"] == f"{p:016x}"
        seen, todo = {i}, [i]
        while todo:
            a = prints[todo.pop()]
            for j, b in enumerate(prints):
                if j not in seen and (a ^ b).bit_count() <= 2:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(seen)
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_null_and_large_ids(spark):
    rnd = random.Random(31)
    base = prose(rnd, 900).split(" ")
    near = " ".join([*base[:-1], "other"])
    assert 0 < (brute_fingerprint(" ".join(base)) ^ brute_fingerprint(near)).bit_count() <= 2
    big = 2**53 + 1
    rows = [(None, " ".join(base)), (big + 2, near), (big, near), (None, "alone and without a link"), (None, near), (7, "x"), (7, "y z w")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == sorted([(0, big), (big + 2, big), (big, big), (0, 0), (0, big), (7, 7), (7, 7)])


def test_pigeonhole_finds_every_pair():
    import numpy as np

    rnd = random.Random(12)
    bits = np.array([[rnd.random() < p for p in np.linspace(0.1, 0.9, 64)] for _ in range(200)], dtype=float)
    for distance in (0, 1, 2, 3):
        for parts in (1, 2, 3, 4, 5):
            groups = simhash.group_bits(200, bits.T @ bits, parts)
            assert sorted(b for g in groups for b in g) == list(range(64))
            cost, ts = simhash.allocate([[0.0, *(rnd.random() * 10**t for t in range(distance + 1))] for _ in groups], distance)
            assert sum(t + 1 for t in ts) == distance + 1
            probing = [(g, t) for g, t in zip(groups, ts) if t >= 0]
            if any(t > 1 for _, t in probing):
                continue
            masks = [m & (2**64 - 1) for _, m in simhash.probes(probing)]
            for _ in range(200):
                x = rnd.getrandbits(64)
                y = x
                for b in rnd.sample(range(64), rnd.randint(0, distance)):
                    y ^= 1 << b
                assert any(x & m == y & m for m in masks)


# 7


def filled(sizes, weights, most=3):
    """Targets by repeated resharing of the excess."""
    out, open_, rest = {}, dict(weights), sum(sizes.values())
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            rest -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_targets(spark, seed):
    rnd = random.Random(seed)
    names = [None, "a", "B", "é", "z", "zz"][: 3 + seed]
    texts = [prose(rnd, rnd.randint(0, 400)) for _ in range(150)]
    of = [rnd.choices(names, [1, 30, 1, 4, 2, 3][: len(names)])[0] for _ in texts]
    df = docs(spark, texts, lambda i: of[i])
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    sizes = defaultdict(int)
    for t, s in zip(texts, of):
        sizes[s] += len(WORDS.findall(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    took = defaultdict(int)
    for r in got:
        s = of[r["doc_id"]]
        took[s] += r["taken"]
        assert r["size"] == len(WORDS.findall(texts[r["doc_id"]])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(0.03 * want[s], 16)
    mixed = mixing.mixed_texts(df).collect()
    assert sum(len(WORDS.findall(r["text"])) for r in mixed) == sum(took.values())
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)


def test_mixing_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mixed_texts(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0


def test_mixing_permutations_and_shards(spark):
    sources = mixing.targets(mixing.sized(docs(spark, [prose(random.Random(i), 100) for i in range(200)])))
    slots = mixing.draw(sources)
    counts = mixing.shard_counts(slots)
    assert counts.agg(F.sum("slots")).head()[0] == sources.agg(F.sum("slots")).head()[0]
    # bijections for any number of blocks
    rows = [(s, n, n, "x", 7) for s, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 63, 64, 65, 1000, 4097])]
    made = spark.createDataFrame([(s, src, 3 * n, n, k) for s, n, _, src, k in rows], "s int, source string, slots long, blocks long, shards long")
    got = defaultdict(list)
    for r in mixing.draw(made).orderBy("s", "slot").collect():
        got[r["s"], r["turn"]].append(r["block_no"])
    for s, n, *_ in rows:
        for turn in range(3):
            assert sorted(got[s, turn]) == list(range(n))
    long = got[12, 0]
    assert got[12, 1] != long and len({b - a for a, b in zip(long, long[1:])}) > 1000  # no fixed stride
    per = mixing.draw(made).where("s = 12").groupBy("shard").count().collect()
    assert len(per) == 7 and all(abs(r["count"] - 3 * 4097 / 7) < 200 for r in per)


def test_mixing_blocks_by_shard(spark):
    rnd = random.Random(29)
    texts = [prose(rnd, rnd.randint(0, 300)) for _ in range(60)]
    df = docs(spark, texts).unionByName(docs(spark, texts[:5]))  # repeated rows
    took = mixing.mix(df)
    blocks = mixing.mixed_blocks(df).collect()
    assert sum(len(WORDS.findall(r["text"])) for r in blocks) == took.agg(F.sum("taken")).head()[0]
    of = {i: set(WORDS.findall(t)) for i, t in enumerate(texts)}
    stream = defaultdict(list)
    for i, t in enumerate(texts):
        stream[f"s{i % 3}"] += WORDS.findall(t) * (2 if i < 5 else 1)
    size = max(len(WORDS.findall(r["text"])) for r in blocks)
    for r in blocks:
        assert WORDS.findall(r["text"]) == stream[r["source"]][r["block_no"] * size : (r["block_no"] + 1) * size]
    assert of and sum(len(WORDS.findall(r["text"])) for r in mixing.mixed_texts(df).collect()) == took.agg(F.sum("taken")).head()[0]


def test_numbered_copies(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [(None,)] * 2, "k string").repartition(5)
    got = defaultdict(list)
    for r in mixing.numbered(df, "k", "c").where("k IS NOT NULL").collect():
        got[r["k"]].append(r["c"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(1, 51)), "b": [1, 2, 3]}


# 8


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark)


def test_licenses(spark, odd, none, license_model):
    import textwrap

    notices = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts]
    ways = [
        lambda i, t: f"{prose(random.Random(i), 40)}\n{t}\n\n{prose(random.Random(-i), 20)}",
        lambda i, t: "\n".join("// " + x for x in textwrap.wrap(t, 72)),
        lambda i, t: "/*\n * " + "\n * ".join(textwrap.wrap(t, 50)) + "\n */",
    ]
    cases = [(f, way(i, t)) for i, (f, t) in enumerate(notices) for way in ways]
    got = defaultdict(list)
    for r in licenses.scan(docs(spark, [t for _, t in cases]), license_model).collect():
        got[r["doc_id"]].append(r["family"])
        assert 0 <= r["probability"] <= 1 and (r["similarity"] is None or r["similarity"] <= 1)
    assert [got[i] for i in range(len(cases))] == [[f] for f, _ in cases]
    plain = ["The license plate was lost on the road.", "Nothing of the kind.", prose(random.Random(5), 300), "Please bring a fishing licence to the office"]
    assert licenses.scan(docs(spark, plain), license_model).count() == 0
    other = ["Licensed under the Apache License, Version 1.1.", "All rights reserved.", "Licensed under the Sleepycat License."]
    assert [r["family"] for r in licenses.scan(docs(spark, other), license_model).orderBy("doc_id").collect()] == ["unknown"] * 3
    assert licenses.scan(odd, license_model).count() == 0
    assert licenses.scan(none, license_model).count() == 0


def test_licenses_of_repeated_rows(spark, license_model):
    t = "Licensed under the MIT license."
    df = spark.createDataFrame([(1, t), (1, t), (1, "Released under the BSD 3-Clause License."), (None, t), (2, t)], "doc_id long, text string")
    got = licenses.scan(df, license_model).collect()
    mit = [r for r in got if r["family"] == "MIT"]
    assert len(got) == 5 and len(mit) == 4 and len({(r["probability"], r["similarity"]) for r in mit}) == 1


def test_license_score_is_the_regression(spark, license_model):
    from math import exp

    m = license_model
    at = {g: i for i, g in enumerate(m.features)}
    texts = [t for texts in licenses.TEMPLATES.values() for t in texts[:2]]
    for r in licenses.scan(docs(spark, texts), m).collect():
        w = re.findall(r"[^\W_]+", texts[r["doc_id"]].lower())
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        z = [(m.intercepts[c] + sum(m.weights[at[g]][c] for g in grams if g in at)) / m.temperature for c in range(len(m.classes))]
        top = max(z)
        assert r["family"] == m.classes[z.index(top)] and r["probability"] == pytest.approx(1 / sum(exp(v - top) for v in z))


# 9


def turns(text):
    return list(chat.Reader().feed(text))


def test_chat_fold_and_template(spark):
    rows = [
        (1, 0, "a", "message", "user", "hi <|end|>\n\\ <|"), (1, 1, "b", "message", "assistant", "par"), (1, 2, "b", "delta", None, "tial"), (1, 3, "b", "regenerate", None, ""), (1, 4, "b", "delta", None, "whole \\"), (1, 5, "b", "delta", None, "<|turn|>"),
        (1, 6, "c", "message", "user", "gone"), (1, 7, "c", "delete", None, None), (1, 8, "a", "edit", None, "hello <\\| \\\\"), (2, None, "x", "message", None, None), (None, 1, "y", "message", "assistant", "🙂"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, message string, kind string, role string, text string")
    pieces = chat.render(chat.fold_events(log))
    whole = {r["conv_id"]: r for r in chat.assemble(pieces).collect()}
    assert turns(whole[1]["formatted"]) == [("user", "hello <\\| \\\\"), ("assistant", "whole \\<|turn|>")]
    assert turns(whole[2]["formatted"]) == [("", "")] and turns(whole[None]["formatted"]) == [("assistant", "🙂")]
    span = whole[1]["loss"][0]
    assert chat.unescape(whole[1]["formatted"][span["start"] : span["end"]]) == "whole \\<|turn|>"
    with pytest.raises(Exception, match="no such kind"):
        chat.fold_events(log.withColumn("kind", F.lit("other"))).count()


def test_chat_digest(spark):
    rnd = random.Random(13)
    bits = ["<|turn|>", "<|text|>", "<|end|>\n", "\\", "<", "|", "<|", "</turn>", "### Assistant:", "é🙂", " word "]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", "".join(rnd.choices(bits, k=rnd.randint(0, 9)))])) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(99, 0, "user", "tie"), (99, 0, "user", "tie"), (99, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    df = df.unionByName(spark.createDataFrame([(100, None, "assistant", "null turn 🙂" * 300), (100, 1, "user", "after"), (None, 0, "user", "null id")], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")))
    rows += [(100, -1, "assistant", "null turn 🙂" * 300), (100, 1, "user", "after"), (None, 0, "user", "null id")]
    log = chat.streamed(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "edit", "regenerate", "delta"}
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, ts in by.items():
        ts = sorted(ts)
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_chats(df.where("false"))).count() == 0


def test_chat_query_has_the_added_conversation(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op9_chat_formatting(spark, sf_dir).collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(text)
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    assert set(got) == {*by, -7}
    for c, ts in by.items():
        ts.sort()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# 10


def shingles(text):
    w = WORDS.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints_against_brute_force(spark, monkeypatch):
    rnd = random.Random(17)
    texts = ["", "one", "one two", None, *(prose(rnd, rnd.randint(0, 300)) for _ in range(40)), prose(rnd, 20)]
    texts += [texts[-1], texts[-1]]
    df = docs(spark, texts)
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (9,))  # many ranges
    got = {r["doc_id"]: r for r in fingerprint.near_edited(df).collect()}
    order = sorted(range(len(texts)), reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - like(shingles(a), shingles(edited))) < 0.17
        assert abs(r["near_next"] - like(shingles(a), shingles(b))) < 0.17
    assert got[len(texts) - 1]["fingerprint"] == got[len(texts) - 2]["fingerprint"] and got[len(texts) - 1]["near_next"] == 1.0


def test_sketch_is_the_least_hashes(spark):
    """Against the same hashes one row at a time: the fingerprint is the 128 least, the likeness a count over both."""
    rnd = random.Random(37)
    texts = ["", "one", "a b c d", *(prose(rnd, n) for n in (5, 6, 100, 132, 133, 700, 700))]
    df = docs(spark, texts)
    rows = spark.createDataFrame([(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(WORDS.findall(t))], "doc_id long, k int, w string").withColumn("x", F.xxhash64("w"))
    near = rows
    for j in range(1, 5):
        near = near.join(rows.select("doc_id", (F.col("k") - j).alias("k"), F.col("x").alias(f"x{j}")), ["doc_id", "k"])
    want = defaultdict(set)
    for r in near.select("doc_id", F.shiftrightunsigned(F.xxhash64("x", "x1", "x2", "x3", "x4"), 16).alias("s")).collect():
        want[r["doc_id"]].add(r["s"])
    for r in rows.groupBy("doc_id").agg(F.count("w").alias("n"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("a")).where("n < 5").select("doc_id", F.shiftrightunsigned(F.xxhash64(F.transform("a", lambda v: v["x"])), 16).alias("s")).collect():
        want[r["doc_id"]].add(r["s"])
    sketch = {i: sorted(want[i])[: fingerprint.K] for i in range(len(texts))}
    got = {r["doc_id"]: r for r in fingerprint.near_edited(df).collect()}
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == "".join(f"{x:012x}" for x in sketch[i])
        a, b = sketch[i], sketch[i - 1 if i else len(texts) - 1]
        least = sorted({*a, *b})[: fingerprint.K]
        assert got[i]["near_next"] == (len({*least} & {*a} & {*b}) / len(least) if least else 1.0)


def test_sketches_merge(spark):
    rnd = random.Random(19)
    sets = [[rnd.getrandbits(48) for _ in range(n)] for n in (0, 5, 500, 2000)]
    sketch = lambda v: sorted(set(v))[: fingerprint.K]
    rows = [(sketch(a), sketch(b), sketch(a + b)) for a in sets for b in sets]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, c array<long>")
    assert df.where(fingerprint.merge(F.col("a"), F.col("b")) != F.col("c")).count() == 0
    parts = spark.createDataFrame([(1, sketch(sets[2])), (1, sketch(sets[3])), (2, []), (3, sketch(sets[1]))], "k int, sketch array<long>")
    whole = {r["k"]: r["sketch"] for r in fingerprint.merge_parts(parts, ["k"]).collect()}
    assert whole == {1: sketch(sets[2] + sets[3]), 2: [], 3: sketch(sets[1])}
    n = df.select(fingerprint.distinct_count(F.col("c"))).collect()
    assert abs(n[-2][0] - 2500) < 900


def test_fingerprints_odd(spark, odd, none):
    assert fingerprint.near_edited(odd).count() == odd.count()
    assert fingerprint.near_edited(none).count() == 0
    assert fingerprint.near_edited(odd.where("doc_id = 5")).head()["near_next"] == 1.0
    got = {r["text"]: r["fingerprint"] for r in fingerprint.fingerprints(odd).collect()}
    assert got[None] == "" and got[" "] == "" and got["one"] != got["one two"]


# shared


def test_block_cells_meet_every_pair(spark):
    df = spark.createDataFrame([("hot", i) for i in range(57)] + [("two", 100), ("two", 101), ("one", 200)], "k string, id long")
    cells = shared.block_cells(df, ["k"], "id", 10).collect()
    by, pairs = defaultdict(list), defaultdict(int)
    for r in cells:
        by[(r["k"], r["_i"], r["_j"])].append((r["id"], r["_k"]))
    for (_, i, j), rows in by.items():
        for a, p in rows:
            for b, q in rows:
                if a < b and {p, q} == {i, j}:
                    pairs[(a, b)] += 1
    assert len(pairs) == 57 * 56 // 2 + 1 and set(pairs.values()) == {1}


def test_components(spark):
    rnd = random.Random(23)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]} | {x: top(x) for x in got}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    random.Random(7).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "u long, v long")
    got = {r["id"]: r["component"] for r in shared.components(chain, most_rounds=30).collect()}
    assert got == dict.fromkeys(range(1000), 0)
    with pytest.raises(RuntimeError, match="still move"):
        shared.components(chain, most_rounds=2)
