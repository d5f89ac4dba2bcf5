"""Benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of every sliding window of k-grams, ties included. With k + w - 1 equal to the
span that counts (13 words), every shared span has a shared fingerprint. Documents' fingerprints are joined with the
benchmark's, and each hit is extended to the whole windows around it, which are compared by word hashes.

A benchmark of at most ``BLOCK_WORDS`` words, which is checked first, is indexed and broadcast; documents are read in one narrow pass and nothing is
shuffled. A larger one is never collected: fingerprints, then the windows around hits, meet in two joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, chunks, grams, without, written

WINDOW, K = 13, 7
BLOCK_WORDS = 2_000_000
_BITS = 22
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Which positions hold the minimum of some w consecutive hashes; all of equal minima count."""
    if not len(g):
        return np.zeros(0, bool)
    w = min(w, len(g))
    low = g[: len(g) - w + 1].copy()
    for d in range(1, w):
        np.minimum(low, g[d : d + len(low)], out=low)
    chosen = np.zeros(len(g), bool)
    for d in range(w):
        chosen[d : d + len(low)] |= g[d : d + len(low)] == low
    return chosen


def _bounded(words: Words, n: int) -> np.ndarray:
    """n-gram hashes by word position; all ones where the gram would leave its document."""
    g = np.full(len(words), _NONE)
    if len(words) >= n:
        x = grams(words.hash, n)
        g[: len(x)] = np.where(words.left()[: len(x)] >= n, x, _NONE)
    return g


class HashSet:
    """Sorted hashes behind a bit table that answers most misses."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.values & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x that are in the set, and their places in values."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(x & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[place] == x[at]
        return at[ok], place[ok]


class BenchmarkIndex:
    """Fingerprints and windows of a benchmark of bounded size."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        words = Words([t for _, t in items], ALNUM)
        length = np.diff(words.first)
        names = np.array([i for i, _ in items], dtype=object)
        g = _bounded(words, k)
        long_enough = length[words.doc] >= window
        chosen = winnow(g, window - k + 1) & (g != _NONE) & long_enough
        self.prints = HashSet(g[chosen])
        self.sizes: list[tuple[int, HashSet, np.ndarray]] = []
        self.sets: list[list[str]] = []
        seen: dict[tuple[str, ...], int] = {}
        for n in sorted({int(x) for x in length if 0 < x < window} | ({window} if (length >= window).any() else set())):
            g = _bounded(words, n)
            keep = np.flatnonzero((g != _NONE) & ((length[words.doc] == n) if n < window else long_enough))
            by = HashSet(g[keep])
            _, place = by.find(g[keep])
            owners: list[set[str]] = [set() for _ in by.values]
            for p, d in zip(place.tolist(), words.doc[keep].tolist(), strict=True):
                owners[p].add(names[d])
            kinds = np.zeros(len(owners), np.int64)
            for p, o in enumerate(owners):
                kinds[p] = seen.setdefault(tuple(sorted(o)), len(seen))
            self.sizes.append((n, by, kinds))
        self.sets = [list(x) for x in seen]

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """(hit, by word; numbers of item sets that occur, by document)."""
        delta = np.zeros(len(words) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(words.first) - 1)]
        for n, by, kinds in self.sizes:
            if len(words) < n:
                continue
            if n == self.window:
                g = _bounded(words, self.k)
                at, _ = self.prints.find(np.where(winnow(g, self.window - self.k + 1), g, _NONE))
                at = at[g[at] != _NONE]
                start = np.unique((at[:, None] - np.arange(self.window - self.k + 1)).ravel())
                start = start[(start >= 0) & (start <= len(words) - n)]
                if not len(start):
                    continue
                whole = np.where(words.left()[start] >= n, grams(words.hash, n)[start], _NONE)
                at, place = by.find(whole)
                at, place = at[whole[at] != _NONE], place[whole[at] != _NONE]
                at = start[at]
            else:
                g = _bounded(words, n)
                at, place = by.find(g)
                at, place = at[g[at] != _NONE], place[g[at] != _NONE]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n, -1)
            for d, kind in np.unique(np.stack([words.doc[at], kinds[place]], 1), axis=0).tolist() if len(at) else []:
                found[d].add(kind)
        return np.cumsum(delta[:-1]) > 0, found


def _low(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows of n words, their fingerprints: the least hash of their k-grams)."""
    m, k = len(words) - n + 1, min(k, n)
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _bounded(words, k)
    low = g[:m].copy()
    for d in range(1, n - k + 1):
        np.minimum(low, g[d : d + m], out=low)
    at = np.flatnonzero(words.left()[:m] >= n)
    return at, low[at]


def _of_windows(words: Words, n: int, at: np.ndarray) -> list[pa.Array]:
    return [pa.array((grams(words.hash, n, second)[at] if len(at) else np.zeros(0, np.uint64)).view(np.int64)) for second in (False, True)]


def _joined(docs: DataFrame, bench: DataFrame, raw: str, window: int, k: int) -> DataFrame:
    """docs with n_words, n_hit and items, by joins with a benchmark (item_id, text) of any size; equal texts are searched once."""
    key = F.md5(F.coalesce(F.col(raw), F.lit(b"")))

    def item_windows(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks(sizes):
                words = Words([x or b"" for x in batch.column(1)[lo:hi].to_pylist()], ALNUM)
                length = np.diff(words.first)
                for n in sorted({min(window, int(x)) for x in length if x}):
                    at, low = _low(words, n, k)
                    own = (length[words.doc[at]] == n) | (n == window)
                    at, low = at[own], low[own]
                    names = batch.column(0)[lo:hi].take(pa.array(words.doc[at]))
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(at), n), pa.int32()), pa.array(low.view(np.int64)), *_of_windows(words, n, at)], names=["item", "n", "f", "w1", "w2"])

    rows = bench.select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text").mapInArrow(item_windows, "item string, n int, f bigint, w1 bigint, w2 bigint")
    windows = written(rows.groupBy("n", "f", "w1", "w2").agg(F.collect_set("item").alias("own")))
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ``window`` numbers

    def prints(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks(lengths):
                words = Words([x or b"" for x in batch.column(1)[lo:hi].to_pylist()], ALNUM)
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                for n in sizes:
                    at, low = _low(words, n, k)
                    for d, f in np.unique(np.stack([words.doc[at].astype(np.int64), low.view(np.int64)], 1), axis=0).tolist() if len(at) else []:
                        out[d].append({"n": n, "f": f})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(words.first), pa.int64()), pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("f", pa.int64())])))], names=["key", "n_words", "prints"]
                )

    texts = docs.select(key.alias("key"), F.col(raw).alias("raw"))
    read = written(texts.mapInArrow(prints, "key string, n_words bigint, prints array<struct<n:int,f:bigint>>"))
    hits = read.select("key", F.explode("prints").alias("p")).select("key", "p.n", "p.f").distinct().join(windows.select("n", "f").distinct(), ["n", "f"])
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("n", "f")).alias("hits"))
    candidates = texts.join(hits, "key").groupBy("key").agg(F.first("raw").alias("raw"), F.first("hits").alias("hits"))

    def extended(batches):
        for batch in batches:
            for key_of, text, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, by = Words([text.as_py() or b""], ALNUM), {}
                for h in own.as_py():
                    by.setdefault(h["n"], []).append(h["f"])
                for n, fs in by.items():
                    at, low = _low(words, n, k)
                    at = at[np.isin(low.view(np.int64), fs)]
                    yield pa.RecordBatch.from_arrays([pa.array([key_of.as_py()] * len(at), pa.string()), pa.array(np.full(len(at), n), pa.int32()), pa.array(at, pa.int64()), *_of_windows(words, n, at)], names=["key", "n", "start", "w1", "w2"])

    near = candidates.mapInArrow(extended, "key string, n int, start bigint, w1 bigint, w2 bigint")
    found = near.join(windows.select("n", "w1", "w2", "own"), ["n", "w1", "w2"]).groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items")
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    joined = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))).alias("hit"))
    found = written(found.select("key", F.aggregate("spans", start, joined)["hit"].alias("n_hit"), "items"))
    counts = read.groupBy("key").agg(F.first("n_words").alias("n_words"))
    out = docs.withColumn("_decon_key", key).join(counts.join(found, "key", "left").withColumnRenamed("key", "_decon_key"), "_decon_key").drop("_decon_key")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K,
    block_words: int = BLOCK_WORDS, drop_text: bool = False,
) -> DataFrame:
    """Each row of docs with n_words, n_hit, items (sorted array of item ids as strings) and contaminated.

    A word is a lower-cased run of letters and digits. A window is ``window`` consecutive words of an item, or all words of a
    shorter one; document words inside any occurrence of a window are hit, and 1 in 20 of them contaminates.
    Null and empty texts have no words: all counts 0, not contaminated; so have null items. A null item id counts
    as ''. Texts of any length are searched whole. Repeated rows each give a row, repeated items count once by id. Empty tables give empty or clean results. Columns of docs named like the outputs are replaced,
    others are carried along.
    """
    out = ["n_words", "n_hit", "items", "contaminated"]
    docs = without(docs, [*out, "_decon_text", "_decon_key"])
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    df = docs.withColumn("_decon_text", F.col(text).cast("binary"))
    if drop_text:
        df = df.drop(text)
    carry = list(df.columns)
    # a word and the gap after it take two bytes at least
    size = items.agg(F.sum((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2)).first()[0] or 0
    if size > block_words:
        df = _joined(df, items, "_decon_text", window, k)
    else:
        index = df.sparkSession.sparkContext.broadcast(BenchmarkIndex([(r["item_id"] or "", bytes(r["text"] or b"")) for r in items.collect()], window, k))
        schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
        df = df.mapInArrow(_scanner(index, carry), schema)
    return df.select(
        *[f"`{c}`" for c in carry if c != "_decon_text"], "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _scanner(index, carry: list[str]):
    """A pass over the documents with the broadcast index."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            raw = batch.column(names.index("_decon_text"))
            for lo, hi in chunks(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
                words = Words([b or b"" for b in raw[lo:hi].to_pylist()], ALNUM)
                hit, found = index.value.scan(words)
                total = np.concatenate([[0], np.cumsum(hit)])
                items = [sorted({x for kind in own for x in index.value.sets[kind]}) for own in found]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(names.index(c))[lo:hi] for c in carry], pa.array(np.diff(words.first), pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array(items, pa.list_(pa.string()))],
                    names=[*carry, "n_words", "n_hit", "items"],
                )

    return run


def items_digest(items: F.Column) -> F.Column:
    """Lowercase hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.concat_ws(",", items), 256)


def brute_force(docs: list[bytes], items: list[tuple[str, bytes]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) by comparing every window with every position; for tests."""
    import re

    cutter = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: cutter.findall(t.lower() if isinstance(t, str) else bytes(b + 32 if 65 <= b <= 90 else b for b in t))
    out = []
    for text in docs:
        w, hit, own = split(text), set(), set()
        for name, body in items:
            v = split(body)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        own.add(name)
        out.append((len(w), len(hit), sorted(own)))
    return out


#: The query's rows; windows are compared as texts here.
ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS k FROM bs),
dn AS (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM dn)),
m AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

__all__ = ["BenchmarkIndex", "brute_force", "decontaminate", "items_digest", "winnow"]
