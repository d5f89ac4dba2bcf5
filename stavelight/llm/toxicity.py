"""Toxicity by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: a word or word prefix counts as toxic where its document frequency in toxic and other
training documents differs beyond chance (G test, corrected for the number tested). A two-state chain is trained on
those tokens by gradient ascent on the exact likelihood; scoring runs forward-backward over chains of at most ``CHAIN`` words of one line, many at once.
The marginals give the offending spans, and their sum, maximum and mean give the document's score through a logistic calibration.

Fitting takes a bounded sample (``SAMPLE`` labelled rows of each class in hash order, texts of at most ``SAMPLE_CHARS`` characters, near copies of
which count once); the chain is trained on all words of these. Every document is scored whole, in one narrow pass with the model broadcast
(at most ``FEATURES`` weights). Nothing is shuffled but the labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, CHUNK, Words, chunks, mix, without
from .decontaminate import HashSet

SAMPLE, SAMPLE_CHARS, FEATURES, CHAIN = 1500, 20_000, 20_000, 64
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
THRESHOLD = 0.7


def lowered(raw: bytes | None) -> bytes:
    """Lower case, as long as this keeps the number of code points; else A-Z only."""
    text = (raw or b"").decode("utf-8", "replace")
    low = text.lower()
    return (low if len(low) == len(text) else text).encode("utf-8")


class Tokens:
    """Words of some documents with their features and their chains."""

    def __init__(self, blobs: list[bytes]):
        self.words = Words(blobs, ALNUM)
        self.base = np.cumsum([0] + [len(b) + 1 for b in blobs])  # where each document starts
        self.features = [mix(self.words.hash + np.uint64(1)), *[self.words.prefix(n) for n in PREFIXES]]
        n = len(self.words)
        line = np.cumsum(np.frombuffer(self.words.data, np.uint8) == 10)[self.words.start] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        if n:
            new[1:] = (line[1:] != line[:-1]) | (self.words.doc[1:] != self.words.doc[:-1])
        first = np.flatnonzero(new)
        inside = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        self.chain_start = np.flatnonzero(inside % CHAIN == 0)
        self.chain_size = np.diff(np.append(self.chain_start, n))


@dataclass
class Model:
    """Weights of the chain (state 0 is clean, 1 toxic) and of the calibration."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -5.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0, 0.0]))

    def __post_init__(self) -> None:
        self.known = HashSet(self.features)
        self.order = np.argsort(self.features)

    def emissions(self, tokens: Tokens) -> np.ndarray:
        out = np.full(len(tokens.words), self.bias)
        w = self.weights[self.order]
        for f in tokens.features:
            at, place = self.known.find(f)
            out[at] += w[place]
        return out

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """P(toxic) of each word. Chains without a known feature depend on their length alone and are looked up."""
        e = self.emissions(tokens)
        out = np.zeros(len(e))
        if not len(e):
            return out
        start, size = tokens.chain_start, tokens.chain_size
        busy = np.add.reduceat((e != self.bias).astype(np.int64), start) > 0
        for n in np.unique(size[~busy]):
            rows = start[~busy & (size == n)]
            out[rows[:, None] + np.arange(n)] = forward_backward(np.full((1, n), self.bias), np.array([n]), self.move)[0]
        rows = np.flatnonzero(busy)
        rows = rows[np.argsort(size[rows], kind="stable")]
        for lo in range(0, len(rows), 4096):
            s, n = start[rows[lo : lo + 4096]], size[rows[lo : lo + 4096]]
            at = np.minimum(s[:, None] + np.arange(n.max()), len(e) - 1)
            p, _, _ = forward_backward(e[at], n, self.move)
            ok = np.arange(n.max()) < n[:, None]
            out[at[ok]] = p[ok]
        return out


def forward_backward(e: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected moves and log partition of padded chains with emission e for state 1 and 0 for state 0."""
    rows, n = e.shape
    live = np.arange(n) < size[:, None]
    up, down = np.zeros((rows, n, 2)), np.zeros((rows, n, 2))
    up[:, 0, 1] = e[:, 0]
    for i in range(1, n):
        new = np.logaddexp(up[:, i - 1, :1] + move[0], up[:, i - 1, 1:] + move[1])
        new[:, 1] += e[:, i]
        up[:, i] = np.where(live[:, i, None], new, up[:, i - 1])
    z = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
    pairs = np.zeros((2, 2))
    for i in range(n - 2, -1, -1):
        ahead = down[:, i + 1] + np.stack([np.zeros(rows), e[:, i + 1]], 1)
        new = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
        on = live[:, i + 1]
        down[:, i] = np.where(on[:, None], new, 0.0)
        pairs += np.exp(up[on, i, :, None] + move + ahead[on][:, None, :] - z[on, None, None]).sum(0)
    p = np.exp(np.minimum(up[:, :, 1] + down[:, :, 1] - z[:, None], 0.0)) * live
    return p, pairs, z


def select_features(docs: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, signed G, toxic?) of features in three documents or more, at most FEATURES by |G|."""
    every, total = np.unique(np.concatenate(docs), return_counts=True) if docs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = [d for d, y in zip(docs, label, strict=True) if y]
    bad = np.zeros(len(every))
    if own:
        f, n = np.unique(np.concatenate(own), return_counts=True)
        bad[np.searchsorted(every, f)] = n
    ok = (total >= 3) & (every != 0)
    every, total, bad = every[ok], total[ok].astype(float), bad[ok]
    rate = max(label.mean(), 1e-9) if len(label) else 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda o, x: np.where(o > 0, o * np.log(o / x), 0.0)
        g = 2 * (term(bad, total * rate) + term(total - bad, total * (1 - rate)))
    sign = np.where(bad > total * rate, 1.0, -1.0)
    toxic = (sign > 0) & (g > 2 * np.log(2.0 * max(len(every), 1))) & (bad >= 0.8 * total)
    best = np.argsort(-g, kind="stable")[:FEATURES]
    return every[best], (sign * g)[best], toxic[best]


def distinct(blobs: list[bytes]) -> list[int]:
    """Places of the documents that are no near copies of an earlier one: copies would make chance words look telling.

    A document is one if at least half of its eight smallest word-pair hashes were among those of documents kept before.
    """
    seen: set[int] = set()
    kept = []
    for lo, hi in chunks([len(b) for b in blobs]):
        words = Words(blobs[lo:hi], ALNUM)
        for d in range(hi - lo):
            h = words.hash[words.first[d] : words.first[d + 1]]
            own = np.unique(mix(h[:-1] + np.uint64(3) * h[1:]) if len(h) > 1 else h)[:8].tolist()
            if not own or 2 * sum(x in seen for x in own) < len(own):
                kept.append(lo + d)
                seen.update(own)
    return kept


def _batches(es: list[np.ndarray], ts: list[np.ndarray], rows: int = 4096) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of like length, padded: (features, labels, sizes)."""
    size = np.array([len(x) for x in ts])
    order, out = np.argsort(size, kind="stable"), []
    for lo in range(0, len(order), rows):
        at = order[lo : lo + rows]
        wide = int(size[at].max())
        ids, lab = np.full((len(at), wide, es[0].shape[1]), -1, np.int32), np.zeros((len(at), wide), bool)
        for i, j in enumerate(at.tolist()):
            ids[i, : size[j]], lab[i, : size[j]] = es[j], ts[j]
        out.append((ids, lab, size[at]))
    return out


def _expected(theta: np.ndarray, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Expected counts of features, toxic words and moves under the chain."""
    n = len(theta) - 4
    w, move = np.append(theta[:n], 0.0), np.array([[0.0, theta[n + 1]], [theta[n + 2], theta[n + 3]]])
    out = np.zeros_like(theta)
    for ids, _, size in batches:
        p, pairs, _ = forward_backward(theta[n] + w[ids].sum(2), size, move)
        expect = np.bincount(ids.ravel() + 1, np.repeat(p.ravel(), ids.shape[2]), minlength=n + 1)[1:]
        out += np.concatenate([expect, [p.sum(), pairs[0, 1], pairs[1, 0], pairs[1, 1]]])
    return out


def _ascended(es: list[np.ndarray], ts: list[np.ndarray], n: int, rounds: int) -> np.ndarray:
    """Weights of n features, bias, moves 0>1, 1>0, 1>1: gradient ascent on the likelihood of all chains, a batch in memory at a time."""
    batches = _batches(es, ts)
    es.clear()
    ts.clear()
    theta, target, moves, toxic = np.zeros(n + 4), np.zeros(n), np.zeros(3), 0
    theta[n] = -3.0
    for ids, lab, size in batches:
        both = (np.arange(lab.shape[1]) < size[:, None])[:, 1:]
        target += np.bincount(ids[lab][ids[lab] >= 0], minlength=n)
        moves += [(both & ~lab[:, :-1] & lab[:, 1:]).sum(), (both & lab[:, :-1] & ~lab[:, 1:]).sum(), (both & lab[:, :-1] & lab[:, 1:]).sum()]
        toxic += lab.sum()
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = np.concatenate([target, [toxic], moves]) - 0.5 * theta - _expected(theta, batches)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return theta


def train(texts: list[bytes], label: list[int], weight_of_clean: float = 1.0, rounds: int = 40) -> Model:
    """Fit on labelled documents; weight_of_clean: clean documents that each sampled one stands for, relative to toxic ones."""
    kept = distinct(texts)
    texts, y = [texts[i] for i in kept], np.array([label[i] for i in kept], bool)
    if not len(y) or y.all() or not y.any():
        p = float(y.mean()) if len(y) else 0.1
        return Model(document=np.array([np.log((p + 0.01) / (1.01 - p)), 0.0, 0.0, 0.0]))
    blobs = [lowered(t) for t in texts]
    # one chunk's tokens at a time, so that the driver needs little memory
    parts = list(chunks([len(b) for b in blobs], CHUNK // 2))
    docs = []
    for lo, hi in parts:
        t = Tokens(blobs[lo:hi])
        for d in range(hi - lo):
            a, b = t.words.first[d], t.words.first[d + 1]
            docs.append(np.unique(np.concatenate([f[a:b] for f in t.features])))
    features, _, toxic = select_features(docs, y)
    del docs
    marks = HashSet(features[toxic])
    known = HashSet(features)
    place_of = np.argsort(features)
    es, ts = [], []  # chains as feature numbers (words x 5, -1 if unknown) and token labels
    for lo, hi in parts:
        t = Tokens(blobs[lo:hi])
        lab = np.zeros(len(t.words), bool)
        ids = np.full((len(t.words), len(t.features)), -1, np.int32)
        for j, f in enumerate(t.features):
            at, _ = marks.find(f)
            lab[at] = True
            at, place = known.find(f)
            ids[at, j] = place_of[place]
        lab &= y[lo:hi][t.words.doc]
        for s, n in zip(t.chain_start.tolist(), t.chain_size.tolist(), strict=True):
            es.append(ids[s : s + n])
            ts.append(lab[s : s + n])
    theta = _ascended(es, ts, len(features), rounds)
    n = len(features)
    keep = np.abs(theta[:n]) > 1e-3
    model = Model(features[keep], theta[:n][keep], float(theta[n]), np.array([[0.0, theta[n + 1]], [theta[n + 2], theta[n + 3]]]))
    x = np.concatenate([_document_features(t.words, model.marginals(t)) for t in (Tokens(blobs[lo:hi]) for lo, hi in parts)])
    model.document = _logistic(x, y.astype(float), np.where(y, 1.0, weight_of_clean))
    return model


def _document_features(words: Words, p: np.ndarray) -> np.ndarray:
    """(1, log(1 + sum), maximum, log(1 + mean per 100 words)) by document."""
    n = len(words.first) - 1
    total = np.bincount(words.doc, p, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, words.doc, p)
    return np.stack([np.ones(n), np.log1p(total), most, np.log1p(100 * total / np.maximum(np.diff(words.first), 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - np.array([0.0, *[ridge] * (x.shape[1] - 1)]) * w)
    return w


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled rows of each class outside the held-out fold, texts of at most ``SAMPLE_CHARS`` characters.

    Repeated labels count once, the larger wins; null ids and labels are left out, labels without a document count for nothing, null texts
    are empty. Ties in the sample's hash order go by id. Without rows of both classes, or on empty tables, every score is a constant.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null").where(fold(F.col("_id")) != 1)
    known = known.groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y"))
    count = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    ids = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample) for c in (0, 1)]
    # at most 2 * sample rows
    few = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_t"), F.length(text).alias("_n")).join(few, "_id")
    rows = rows.where(F.coalesce("_n", F.lit(0)) <= SAMPLE_CHARS).select("_id", "_t", "_y").orderBy("_id").limit(2 * sample).collect()
    got = [sum(r["_y"] == c for r in rows) for c in (0, 1)]
    weight = (count.get(0, 0) / max(got[0], 1)) / max(count.get(1, 0) / max(got[1], 1), 1e-9) if all(got) else 1.0
    return train([bytes(r["_t"] or b"") for r in rows], [r["_y"] for r in rows], weight)


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Docs with score (0 to 1) and toxic_spans: code points (start, end) of words whose marginal is over one half.

    Whole texts are scored. Null and empty texts have no words: the calibration's constant is their score. Row-local, so repeated rows
    score alike; an empty table gives an empty one. Columns named score or toxic_spans are replaced, others carried.
    """
    docs = without(docs, ["score", "toxic_spans"])
    df = docs.withColumn("_raw", F.col(text).cast("binary"))
    df = df.drop(text) if drop_text else df
    carry = [c for c in df.columns if c != "_raw"]
    shared = df.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "_raw"], T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", spans)])

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            names = batch.schema.names
            raw = batch.column(names.index("_raw"))
            for lo, hi in chunks(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
                t = Tokens([lowered(b) for b in raw[lo:hi].to_pylist()])
                p = m.marginals(t)
                scores = 1 / (1 + np.exp(-_document_features(t.words, p) @ m.document))
                marks: list[list[dict]] = [[] for _ in range(hi - lo)]
                for i in np.flatnonzero(p > 0.5).tolist():
                    d = int(t.words.doc[i])
                    s = len(t.words.data[t.base[d] : t.words.start[i]].decode("utf-8", "replace"))
                    marks[d].append({"start": s, "end": s + len(t.words.word(i).decode("utf-8", "replace"))})
                yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c))[lo:hi] for c in carry], pa.array(scores, pa.float64()), pa.array(marks, kind)], names=[*carry, "score", "toxic_spans"])

    return df.mapInArrow(run, schema)
