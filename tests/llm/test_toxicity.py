import itertools
import random

import numpy as np

from stavelight.llm import toxicity as tx


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, size, move = rng.normal(size=(4, 5)), np.array([5, 3, 1, 4]), rng.normal(size=(2, 2))
    p, pairs, z = tx.forward_backward(e, size, move)
    expected = np.zeros((2, 2))
    for r in range(4):
        n, total, marg, moves = size[r], 0.0, np.zeros(5), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[r, i] * y for i, y in enumerate(ys)) + sum(move[a, b] for a, b in zip(ys, ys[1:], strict=False)))
            total += w
            for i, y in enumerate(ys):
                marg[i] += w * y
            for a, b in zip(ys, ys[1:], strict=False):
                moves[a, b] += w
        assert np.allclose(p[r], marg / total) and np.isclose(z[r], np.log(total))
        expected += moves / total
    assert np.allclose(pairs, expected)


def corpus(n, rng):
    bad = ["vile", "rotten", "scum", "grubrat", "grubfoe", "grubole"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))]
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words) + ("\n" + words[0] if i % 3 else ""), int(toxic)))
    return rows


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(5)
    rows = corpus(900, rng)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(2000, None, "x"), (2001, "", "x"), (2002, "É " * 50_000 + "scum", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (10, 1), (99_999, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    out = {r.doc_id: r for r in tx.score(docs, model).collect()}
    assert len(out) == 903 and out[2000].score == out[2001].score
    assert all(0 <= r.score <= 1 for r in out.values())
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    right = [(out[i].score >= tx.THRESHOLD) == bool(rows[i][2]) for i in held]
    assert np.mean(right) > 0.97
    r = out[2002].toxic_spans
    assert [(x.start, x.end) for x in r] == [(100_000, 100_004)]
    i = next(i for i in held if rows[i][2])
    assert {rows[i][1][x.start : x.end] for x in out[i].toxic_spans} <= {"vile", "rotten", "scum", "grubrat", "grubfoe", "grubole"}


def test_degenerate_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score(docs, tx.fit(docs, none)).count() == 2
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).count() == 0
    assert tx.score(docs, tx.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).count() == 2


def plain_scores(model, text):
    """(score, spans) of a text, word by word and chain by chain in plain Python."""
    import math
    import re

    from stavelight.llm.common import ALNUM, Words

    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    low = text.lower() if len(text.lower()) == len(text) else text
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)]
    chains, line = [], None
    for i, (s, _) in enumerate(found):
        here = low.count("\n", 0, s)
        if here != line or len(chains[-1]) == tx.CHAIN:
            chains.append([])
        chains[-1].append(i)
        line = here
    p = [0.0] * len(found)
    for chain in chains:
        e = []
        for i in chain:
            t = tx.Tokens([low[found[i][0] : found[i][1]].encode()])
            assert len(t.words) == len(Words([low[found[i][0] : found[i][1]].encode()], ALNUM)) == 1
            e.append(model.bias + sum(weight.get(int(f[0]), 0.0) for f in t.features if f[0]))
        up, down = [[1.0, math.exp(e[0])]], [[1.0, 1.0]]
        for x in e[1:]:
            up.append([sum(up[-1][a] * math.exp(model.move[a][b]) for a in (0, 1)) * (math.exp(x) if b else 1.0) for b in (0, 1)])
        for x in e[:0:-1]:
            down.insert(0, [sum(math.exp(model.move[a][b]) * (math.exp(x) if b else 1.0) * down[0][b] for b in (0, 1)) for a in (0, 1)])
        for i, u, d in zip(chain, up, down, strict=True):
            p[i] = u[1] * d[1] / (u[0] * d[0] + u[1] * d[1])
    total, n = sum(p), max(len(found), 1)
    x = model.document @ [1.0, math.log1p(total), max(p, default=0.0), math.log1p(100 * total / n)]
    return 1 / (1 + math.exp(-x)), [f for f, q in zip(found, p, strict=True) if q > 0.5]


def test_scores_against_plain_python(spark):
    rng = random.Random(6)
    rows = corpus(300, rng)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    more = [(1000, "VILE \n\n rotten-scum\nÉ w1"), (1001, " ".join(rng.choice(["vile", "w1", "w2", "scum"]) for _ in range(300))), (1002, "\n"), (None, "vile"), (1001, "vile vile")]
    docs = spark.createDataFrame([(i, t, 1.5, None) for i, t in [(i, t) for i, t, _ in rows] + more + more[:2]], "doc_id long, text string, score double, toxic_spans string").repartition(3)
    model = tx.fit(docs, labels)
    got = sorted(((r.text, round(r.score, 9), [tuple(x) for x in r.toxic_spans]) for r in tx.score(docs, model).collect()))
    want = sorted((t, round(s, 9), w) for t in [r[1] for r in rows] + [t for _, t in more + more[:2]] for s, w in [plain_scores(model, t)])
    assert got == want and any(w for _, _, w in want)


def test_expected_counts_of_every_chain():
    """What training compares with the labels, against enumeration of all labelings."""
    rng = np.random.default_rng(3)
    es = [rng.integers(-1, 3, (n, 2)).astype(np.int32) for n in (1, 2, 3, 4, 6, 6, 5, 3)]
    theta = rng.normal(size=7)
    want = np.zeros(7)
    for ids in es:
        total, expect = 0.0, np.zeros(7)
        for ys in itertools.product((0, 1), repeat=len(ids)):
            f = np.zeros(7)
            for i, y in enumerate(ys):
                for j in ids[i] if y else []:
                    f[j] += j >= 0
                f[3] += y
            for a, b in zip(ys, ys[1:], strict=False):
                f[4 + (a == 1) + (a == 1 and b == 1)] += (a, b) != (0, 0)
            v = np.exp(f @ theta)
            total, expect = total + v, expect + v * f
        want += expect / total
    for rows in (3, 100):
        assert np.allclose(tx._expected(theta, tx._batches(es, [np.zeros(len(x), bool) for x in es], rows)), want)
