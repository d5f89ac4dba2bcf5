"""Substring dedup: repeated windows of 50 words by de Bruijn compaction in minimizer space.

1. Token k-mers: every document keeps the minimum 16-mer of each 50-word window (its anchors), so a window has an
   anchor that every document holding the window keeps too. Anchors are the graph's nodes; the stretch from one anchor to the
   next, hashed whole, is an edge.
2. One aggregate over the edges finds nodes of two documents or more, and those with a single way in and out: nonbranching ones.
   A join brings these marks back to the documents.
3. Maximal nonbranching paths compact to one record with its coordinates (first and last window) in its document: whoever passes one of its inner
   nodes passes all of it. Only windows around branching nodes and path ends keep a record each.
4. Each record is verified against the text at its coordinates: its key is the MD5 digest of the words themselves that stand there, so records of one key
   have equal words. Records group by key to their smallest document; later documents join back, and their coordinates give the words to remove.

Grouping is combined before the shuffle and joins are sort-merge, whose hot keys AQE splits; a passage that a third of all documents share costs
each of them a record, not a pair. Texts are shuffled once by document: both joins with them share that exchange.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Words, chunks, grams, mix, packed, span_hash, unpacked, without

WINDOW, K = 50, 16
#: Stands for a null id, which neither is a source nor gets cut.
NO_ID = -(1 << 63)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _window_anchor(gram: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost minimum of the n grams from each position; the last n - 1 positions are left out."""
    low = gram[: len(gram) - n + 1].copy()
    for d in range(1, n):
        np.minimum(low, gram[d : d + len(low)], out=low)
    place = np.zeros(len(low), np.int64)
    for d in range(n - 1, -1, -1):
        place = np.where(gram[d : d + len(low)] == low, np.arange(len(low)) + d, place)
    return place


class Anchors:
    """Word hashes and anchors of a chunk of documents."""

    def __init__(self, blobs: list[bytes], window: int, k: int):
        self.words = w = Words(blobs, SPACED)
        n = len(w)
        self.gram = np.full(n, _NONE)
        if n >= k:
            x = grams(w.hash, k)
            self.gram[: len(x)] = np.where(w.left()[: len(x)] >= k, x & ~np.uint64(1), _NONE)
        # of each window that lies in one document; what is around the document in this chunk must not matter
        self.window_at = np.flatnonzero(w.left()[: max(n - window + 1, 0)] >= window)
        self.anchor = _window_anchor(self.gram, window - k + 1)[self.window_at] if len(self.window_at) else self.window_at
        self.at = np.unique(self.anchor)
        self.doc = w.doc[self.at]
        # both edges of each anchor in one number; 0 if its document starts or ends there
        self.way = np.zeros(len(self.at), np.uint64)
        if len(self.at) > 2:
            edge = span_hash(w.hash, self.at[:-1], self.at[1:] + k)
            within = self.doc[2:] == self.doc[:-2]
            self.way[1:-1] = np.where(within, mix(edge[:-1] + np.uint64(3) * edge[1:]) | np.uint64(1), np.uint64(0))


def _anchor_rows(window: int, k: int):
    def run(batches):
        for b in batches:
            blobs = [x or b"" for x in b.column(2).to_pylist()]
            for lo, hi in chunks([len(x) for x in blobs]):
                a = Anchors(blobs[lo:hi], window, k)
                take = pa.array(a.doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array((a.at - a.words.first[a.doc]).astype(np.int32)), _signed(a.gram[a.at]), _signed(a.way)],
                    names=["_id", "_th", "pos", "node", "way"],
                )

    return run


def digests(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of the words [start, end), joined by one space, as two numbers."""
    # the words of the chunk, one space apart, and where each starts there
    text, place = b" ".join(words.data.split()), np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
    raw = b"".join([md5(text[i:j], usedforsecurity=False).digest() for i, j in zip(place[start].tolist(), (place[end] - 1).tolist(), strict=True)])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _record_rows(window: int, k: int):
    """Records (key, document, first and last window) of paths and of single windows."""

    def run(batches):
        for b in batches:
            blobs, marks = [unpacked(x) for x in b.column(2).to_pylist()], b.column(3)
            for lo, hi in chunks([len(x) for x in blobs]):
                a = Anchors(blobs[lo:hi], window, k)
                w, n = a.words, len(a.words)
                if not len(a.at):
                    continue
                repeated, inner = np.zeros(n, bool), np.zeros(n, bool)
                for d in range(hi - lo):
                    x = np.array(marks[lo + d].as_py(), np.int64)
                    at = w.first[d] + (x >> 1)
                    repeated[at] = True
                    inner[at[(x & 1) == 1]] = True
                ok = repeated[a.anchor]
                s, anchor = a.window_at[ok], a.anchor[ok]
                # runs of inner anchors, and how far the path reaches around each
                flag = inner[a.at]
                j = np.arange(len(a.at))
                left = np.maximum.accumulate(np.where(flag, -1, j)) if len(j) else j
                right = np.minimum.accumulate(np.where(flag, len(j), j)[::-1])[::-1] if len(j) else j
                number = np.full(n, -1)
                number[a.at] = j
                own = number[anchor]
                path = inner[anchor]
                start, end = a.at[np.maximum(left[own], 0)], a.at[np.minimum(right[own], len(j) - 1)] + k
                path &= (s >= start) & (s + window <= end)
                one, lone = s[path], s[~path]
                parts = [(*digests(w, lone, lone + window), lone, lone)]
                if len(one):
                    new = np.flatnonzero(np.concatenate([[True], (start[path][1:] != start[path][:-1])]))
                    first, last = one[new], one[np.append(new[1:], len(one)) - 1]
                    u, v = start[path][new], end[path][new]
                    parts.append((*digests(w, u, v), first, last))
                k1, k2, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
                d = w.doc[first]
                take = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [_signed(k1), _signed(k2), b.column(0).take(take), b.column(1).take(take), pa.array((first - w.first[d]).astype(np.int32)), pa.array((last - w.first[d]).astype(np.int32))],
                    names=["k1", "k2", "_id", "_th", "first", "last"],
                )

    return run


def _packer(names: list[str]):
    def run(batches):
        for b in batches:
            cols = b.schema.names
            z = [packed(x) for x in b.column(cols.index("_raw")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(cols.index(c)) for c in names], pa.array(z, pa.binary())], names=[*names, "_z"])

    return run


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType() if n in ("pos", "first", "last") else T.LongType(), False) for n in names])


def repeated_ranges(raw: DataFrame, packed: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """raw (_id, _th, _raw) and packed (_id, _th, _z) -> (_id, _th, ranges): runs of windows (first, last) that also start in a document of a smaller id."""
    anchors = raw.where(F.col("_id") != NO_ID).mapInArrow(_anchor_rows(window, k), _longs("_id", "_th", "pos", "node", "way"))
    nodes = anchors.groupBy("node").agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.min("way").alias("c"), F.max("way").alias("d")).where("a < b")
    nodes = nodes.select("node", ((F.col("c") == F.col("d")) & (F.col("c") != 0)).alias("inner"))
    marks = anchors.select("_id", "_th", "pos", "node").join(nodes, "node").select("_id", "_th", (F.col("pos") * F.lit(2) + F.col("inner").cast("int")).alias("mark"))
    marks = marks.groupBy("_id", "_th").agg(F.collect_set("mark").alias("marks"))
    records = packed.join(marks, ["_id", "_th"]).select("_id", "_th", "_z", "marks").mapInArrow(_record_rows(window, k), _longs("k1", "k2", "_id", "_th", "first", "last"))
    source = records.groupBy("k1", "k2").agg(F.min("_id").alias("source"), F.max("_id").alias("_last")).where("source < _last").drop("_last")
    later = records.join(source, ["k1", "k2"]).where("_id > source")
    return later.groupBy("_id", "_th").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """Docs with kept_text (words that stay, joined by one space), n_words and n_removed; the text itself is dropped.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` words over it also starts in a document with
    a smaller id; repeats inside one document or among rows of equal ids stay. Null ids are neither sources nor cut. Null and empty texts
    have no words and an empty kept_text; documents below ``window`` words stay whole. Repeated rows are treated alike. An empty
    table gives an empty one. Columns named like the outputs are replaced, others are carried.
    """
    docs = without(docs, ["kept_text", "n_words", "n_removed", "_id", "_th", "_raw", "_z", "ranges"])
    carry = [f for f in docs.schema.fields if f.name not in (text, doc_id)]
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text).cast("binary")).alias("_th"), F.col(text).cast("binary").alias("_raw"), *[f"`{f.name}`" for f in carry]
    )
    names = ["_id", "_th", *[f.name for f in carry]]
    # not nullable, so that both joins below put the same exchange over it
    packed = keyed.mapInArrow(_packer(names), T.StructType([*_longs("_id", "_th").fields, *carry, T.StructField("_z", T.BinaryType(), False)]))
    ranges = repeated_ranges(keyed.select("_id", "_th", "_raw"), packed.select("_id", "_th", "_z"), window, k)
    both = packed.join(ranges, ["_id", "_th"], "left").drop("_th")
    names.remove("_th")
    schema = T.StructType([T.StructField("_id", T.LongType()), *carry, T.StructField("_out", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = both.mapInArrow(_cutter(names, window), schema)
    kind = docs.schema[doc_id].dataType
    own = {doc_id: F.when(F.col("_id") != NO_ID, F.col("_id")).cast(kind), **{f.name: F.col(f"`{f.name}`") for f in carry}}
    return done.select(*[own[c].alias(c) for c in docs.columns if c != text], F.col("_out").cast("string").alias("kept_text"), "n_words", "n_removed")


def _cutter(names: list[str], window: int):
    def run(batches):
        for b in batches:
            cols = b.schema.names
            out, count, gone = [], [], []
            for z, ranges in zip(b.column(cols.index("_z")).to_pylist(), b.column(cols.index("ranges")).to_pylist(), strict=True):
                words = unpacked(z).split()  # bytes split at ASCII white space
                count.append(len(words))
                if ranges:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, [r["first"] for r in ranges], 1)
                    np.add.at(delta, [r["last"] + window for r in ranges], -1)
                    hit = np.cumsum(delta[:-1]) > 0
                    gone.append(int(hit.sum()))
                    words = [x for x, h in zip(words, hit.tolist(), strict=True) if not h]
                else:
                    gone.append(0)
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(cols.index(c)) for c in names], pa.array(out, pa.binary()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "_out", "n_words", "n_removed"]
            )

    return run


#: The query's rows; windows are compared as texts here.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS source FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, s + unnest(range(0, 50)) AS i FROM x JOIN f USING (k) WHERE doc_id > source),
l AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
k AS (SELECT l.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY l.i), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept text) by row; for tests."""
    words = [(t or "").encode().split() for _, t in rows]
    least: dict[tuple, int] = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[s : s + window])] = min(i, least.get(tuple(w[s : s + window]), i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone: set[int] = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return out
