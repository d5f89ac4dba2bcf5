import random

from stavelight.llm import decontaminate as dc


def data():
    rng = random.Random(8)
    fresh = lambda n: [rng.choice(["alpha", "beta", "Gamma", "delta", "é1", "x2"]) + str(rng.randrange(40)) for _ in range(n)]
    items = [(i, " ".join(fresh(rng.choice([13, 14, 20, 40])))) for i in range(12)]
    items += [(20, "two words"), (21, "!!"), (22, None), (23, ""), (24, " ".join(["a"] * 13)), (25, items[3][1]), (3, "a second text of item three, that has in all fourteen words for one window"), (None, "null id here"), (26, "single")]
    docs = [(100, None), (101, ""), (102, "no hit at all"), (103, "a " * 40), (104, "TWO-words, two Words. single?"), (105, "null ID here")]
    for i in range(110, 170):
        w = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            x = rng.choice(items[:12])[1].split()
            a = rng.randrange(max(1, len(x) - 11))
            w[rng.randrange(len(w) + 1) : 0] = [y.upper() if rng.random() < 0.3 else y for y in x[a : a + rng.choice([12, 13, 30])]]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(w)))
    docs.append((180, " ".join(fresh(30_000)) + " " + items[0][1]))
    return docs + [docs[-1]], items


def test_against_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dc.brute_force([(t or "").encode() for _, t in docs], [("" if i is None else str(i), (t or "").encode()) for i, t in items])
    want = sorted((i, n, h, ids, h > 0 and 20 * h >= n) for (i, _), (n, h, ids) in zip(docs, want, strict=True))
    for block in (2_000_000, 40):  # broadcast, and joined
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.decontaminate(df, bench, block_words=block).collect())
        assert got == want
    assert sum(x[4] for x in want) > 10


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, bench).count() == 0
    for limit in (dc.BLOCK_WORDS, -1):
        one = dc.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench, block_words=limit).first()
        assert (one.n_words, one.n_hit, one["items"], one.contaminated) == (2, 0, [], False)
    assert dc.decontaminate(docs, bench, block_words=-1).count() == 0
