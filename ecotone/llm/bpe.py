"""Byte-level BPE: DuckDB recursive queries, one in-process database for each partition's worker.

The token positions of new words are rows that join the merge table; every step
contracts each word's leftmost pair of least rank, until no pair is in the
table.  A word's last step is its result; a lot's words are taken so that the
rows of all its steps are bounded.  Decoding joins the ids with the vocabulary and aggregates their bytes in order;
this goes for words that are a token, too.  Words repeat, so a worker keeps
what it has computed in a bounded cache.  A step visits every position of a
word that is still open, so runs of LONG bytes and more without a boundary take
a heap over the same table instead, by the same rule.

Nulls count as empty texts.  An empty text has no ids.  Ids, texts and hashes
of equal texts are equal.  Other columns pass through the general operators;
rows with equal ids are kept apart, each gives a row.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotone.llm.shared import worker_cache

#: Entries in the younger half of a worker's cache; beyond this many it becomes the older half. Memory only, results do not depend on it.
CACHE = 250_000
#: Words that one recursive query takes, and the sum of their squared lengths: twice the rows of all its steps at most.
WORDS, ROWS = 10_000, 1_500_000
#: Characters that are encoded at a time.
CHUNK = 1_000_000
#: Bytes from which a word is contracted by a heap.
LONG = 512

MERGE = """
WITH RECURSIVE t(step, w, pos, tok, nxt, ntok) AS (
  SELECT 0, w, pos, tok, nxt, ntok FROM init
  UNION ALL
  (WITH pairs AS (SELECT w, pos, nxt, m FROM t JOIN merges ON lr = ((tok << 20) | ntok)),
   least AS (SELECT w, min((m::BIGINT << 32) | pos) AS best, arg_min(nxt, (m::BIGINT << 32) | pos) AS gone FROM pairs GROUP BY w),
   hit AS (SELECT l.w, best >> 32 AS m, best & 4294967295 AS p, gone, g.nxt AS nxt2, g.ntok AS ntok2 FROM least l JOIN t g ON g.w = l.w AND g.pos = l.gone)
   SELECT step + 1, t.w, t.pos, CASE WHEN pos = p THEN m ELSE tok END, CASE WHEN pos = p THEN nxt2 ELSE nxt END, CASE WHEN pos = p THEN ntok2 WHEN nxt = p THEN m ELSE ntok END
   FROM t JOIN hit ON t.w = hit.w WHERE pos <> gone))
SELECT t.w, pos, tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) z ON z.w = t.w AND z.step = t.step
"""

#: Parts ids from bytes in a cached value: no text in UTF-8 has this byte.
PART = b"\xff"

#: Around it: a word's ids as text, each after a space, and their bytes, in turn and with PART between, as Latin-1 and aggregated in order.
AND_BACK = f"""
WITH got AS ({MERGE} UNION ALL SELECT w, pos, tok FROM whole)
SELECT w, string_agg(v, chr(255) ORDER BY pos) AS v FROM got JOIN vocab ON id = tok GROUP BY w
"""

DECODE = """
SELECT doc, string_agg(s, '' ORDER BY pos) AS s
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM got) AS p JOIN vocab USING (id) GROUP BY doc
"""


class Codec:
    """A vocabulary of byte strings and ranks, in a DuckDB database in memory."""

    def __init__(self, ranks: dict, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.gap = re.compile(r"(?<=\s) ")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        left, to = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append((a << 20) | b)
                    to.append(rank)
        self.con.register("_m", pa.table({"lr": pa.array(left, pa.int64()), "m": pa.array(to, pa.int64())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM _m")
        self.con.register("_v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "s": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT id, s, ' ' || id || chr(255) || s AS v FROM _v")
        self.con.unregister("_m")
        self.con.unregister("_v")
        self.pairs = dict(zip(left, to, strict=True))
        self.known: dict = {}
        self.older: dict = {}

    def _merge(self, words: list) -> list:
        """The cached value of each byte string (ids as text, each after a space, PART, bytes of the ids), by the recursive query; ids of tokens and of long words are known before."""
        import numpy as np
        import pyarrow as pa

        out: list = [None] * len(words)
        whole: list = []
        part = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                whole.append((i, 0, r))
            elif len(w) >= LONG:
                whole.extend((i, k, r) for k, r in enumerate(self._heap(w)))
            else:
                part.append(i)
        lens = np.array([len(words[i]) for i in part], dtype=np.int64)
        flat = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8)
        at = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        tok, after, last = self.byte[flat], at + 1, np.cumsum(lens) - 1
        beside = np.append(tok[1:], -1)[: len(tok)]
        after[last] = beside[last] = -1
        self.con.register("init", pa.table({"w": np.repeat(np.array(part, dtype=np.int64), lens), "pos": at, "tok": tok, "nxt": after, "ntok": beside}))
        self.con.register("whole", pa.table(list(zip(*whole, strict=True)) and [pa.array(c, pa.int64()) for c in zip(*whole, strict=True)] or [pa.array([], pa.int64())] * 3, ["w", "pos", "tok"]))
        for w, v in self.con.execute(AND_BACK).fetchall():
            got = v.encode("latin-1").split(PART)
            out[w] = b"".join(got[::2]) + PART + b"".join(got[1::2])
        self.con.unregister("init")
        self.con.unregister("whole")
        return out

    def _heap(self, word: bytes) -> list:
        """The ids of one long word: the leftmost pair of least rank first, from a heap of (rank, position, both tokens)."""
        from heapq import heapify, heappop, heappush

        n, pairs = len(word), self.pairs
        tok = [int(self.byte[b]) for b in word]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := pairs.get((tok[i] << 20) | tok[i + 1])) is not None]
        heapify(heap)
        while heap:
            m, i, x, y = heappop(heap)
            j = after[i]
            if tok[i] != x or j < 0 or tok[j] != y:
                continue
            tok[i], tok[j], k = m, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0 and (m := pairs.get((tok[p] << 20) | tok[q])) is not None:
                    heappush(heap, (m, p, tok[p], tok[q]))
        return [t for t in tok if t >= 0]

    def decode(self, ids: list) -> list:
        """The bytes of each list of ids, by ordered aggregation."""
        import pyarrow as pa

        self.con.register("got", pa.table({"doc": pa.array(range(len(ids)), pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))}))
        out = [b""] * len(ids)
        for doc, s in self.con.execute(DECODE).fetchall():
            out[doc] = s.encode("latin-1")
        self.con.unregister("got")
        return out

    def _learn(self, units: set, words: set) -> None:
        """Put the values of new units and words into the cache.

        A unit's key is its text without the space before it, which holds no
        space; a word's key is the word after a space.
        """
        known, older, find = self.known, self.older, self.pattern.findall
        ones, many, need = {}, {}, set(words)
        for x in units:
            if (got := older.get(x)) is not None:
                known[x] = got
            elif len(f := find(" " + x)) == 1:
                ones[f[0]] = x
            else:
                many[x] = f
                need.update(f)
        value, new = {}, list(ones)
        for w in need:
            if w in ones:
                continue
            got = known.get(" " + w) or older.get(" " + w)
            if got is None and w[0] == " " and len(w) > 1 and " " not in w[1:] and (got := known.get(w[1:]) or older.get(w[1:])) is not None and find(w) != [w]:
                got = None
            if got is None:
                new.append(w)
            else:
                value[w] = got
        new.sort(key=len)  # the recursion of a lot goes on until its longest word is done
        part, raw, rows = [], [], 0
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            if part and (len(part) == WORDS or rows + len(b) ** 2 > ROWS):
                value.update(zip(part, self._merge(raw), strict=True))
                part, raw, rows = [], [], 0
            part.append(w)
            raw.append(b)
            rows += len(b) ** 2 if len(b) < LONG else 0
        if part:
            value.update(zip(part, self._merge(raw), strict=True))
        for w, x in ones.items():
            known[x] = value[w]
        for w in need:
            if w in words or w[0] != " ":
                known[" " + w] = value[w]
        for x, f in many.items():
            got = PART.join([value[w] for w in f]).split(PART)
            known[x] = b"".join(got[::2]) + PART + b"".join(got[1::2])

    def encode(self, texts: list) -> list:
        """For each text its ids as text, each after a space, and their decoded bytes, both as bytes.

        A boundary between two matches of the pattern lies before each space
        whose predecessor is no white space, so the text between such spaces is
        a unit that can be cached; texts with other spaces go match by match.
        """
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, find = self.known, self.pattern.findall
        parts, units, words = [], set(), set()
        for t in texts:
            if self.gap.search(t):
                keys = [" " + w for w in find(t)]
                words.update(w[1:] for w in keys if w not in known)
            else:
                keys = t.split(" ")
                first = [" " + w for w in find(keys[0])]
                words.update(w[1:] for w in first if w not in known)
                keys = keys[1:]
                units.update(keys)
                keys[:0] = first
            parts.append(keys)
        self._learn(units.difference(known), words)
        out = []
        for keys in parts:
            got = PART.join([known[x] for x in keys]).split(PART)
            out.append((b"".join(got[::2]), b"".join(got[1::2])))
        return out


def load_ranks(path: str) -> dict:
    """Ranks of a file of base64 tokens and ranks, read on the driver; about 1 MB goes to the executors."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _codec(ranks, pattern: str) -> Codec:
    kept = worker_cache("bpe")
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Codec(ranks, pattern)
    return kept[key]


def _chunks(column):
    """(start, texts) of at most CHUNK characters, one text at least."""
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


def encode(df: DataFrame, ranks: dict, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of `text` in the array column `into`."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = f"{df.drop(into).schema.simpleString()[7:-1]}, `{into}`: array<int>"
    kept = [c for c in df.columns if c != into]

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared.value, pattern)
        for batch in batches:
            for start, texts in _chunks(batch.column(batch.schema.get_field_index(text))):
                ids = [[int(i) for i in got[0].split()] for got in codec.encode(texts)]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(ids, pa.list_(pa.int32()))], [*kept, into])

    return df.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes of the id lists in `ids` (null: none) in the binary column `into`."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = f"{df.drop(into).schema.simpleString()[7:-1]}, `{into}`: binary"
    kept = [c for c in df.columns if c != into]

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = codec.decode([v or [] for v in part.column(part.schema.get_field_index(ids)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(got, pa.binary())], [*kept, into])

    return df.select(*kept).mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: dict, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded, without shipping ids between stages."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared.value, pattern)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                n, ids, back = [], [], []
                for got, decoded in codec.encode(texts):
                    n.append(got.count(b" "))
                    ids.append(hashlib.sha256(got[1:]).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
