import random

from stavelight.llm import substrings


def test_against_brute_force(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 120, 400)] + [["a"] * 130, ["x", "y", "z"] * 60]
    rows = [(None, " ".join(passages[4])), (3, None), (4, ""), (5, " \t\n"), (7, "a " * 49)]
    base = fresh(300)
    for i in range(10, 90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else fresh(rng.randrange(0, 80)) for _ in range(rng.randrange(1, 6))]
        w = [x for p in parts for x in p]
        if i % 7 == 0:
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edit"
        if i % 9 == 0 and len(w) > 70:
            w = w[rng.randrange(20) : -rng.randrange(1, 20)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows.append((95, " ".join(fresh(40_000) + passages[5] + fresh(100))))
    rows += [rows[-1], (rows[-1][0], rows[20][1])]
    df = spark.createDataFrame([(i, t, "z", "y", 1) for i, t in rows], "doc_id long, text string, n_words string, Kept_Text string, _id int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(df).collect())
    want = sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, substrings.brute_force(rows), strict=True))
    assert got == want
    assert sum(x[2] for x in want) > 2000


def test_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
