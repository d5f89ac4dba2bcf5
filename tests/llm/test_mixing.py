import random
import re

from stavelight.llm import mixing


def plain_targets(sizes):
    """Source -> target by passing the excess on until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: dict = {}
    total = sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        for s in above:
            capped[s] = 3 * sizes[s]


def check(rows, out):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = plain_targets(sizes)
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, words(t)) for i, t, _ in rows)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size for r in own)
        assert sum(epochs * r.size < r.taken < (epochs + 1) * r.size for r in own) <= 1
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))


def make(rng, n, sources):
    return [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), rng.choice(sources)) for i in range(1, n)]


def test_targets_and_takes(spark):
    rng = random.Random(2)
    for sources in (["a"], ["a", "b", None], ["a"] * 60 + ["b", "c", "d", "é", "\U0001f600", None], [f"s{i}" for i in range(17)] + ["s1"] * 40):
        rows = make(rng, 700, sources) + [(9000, None, "a"), (9001, "", "empty"), (9002, " \t", None)]
        rows += [rows[5], (rows[5][0], "other text here", rows[5][2]), (None, "no id", "a")]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
        labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
        out = mixing.mix_sources(df, labels, slice_rows=40).collect()
        check(rows, out)
        assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(2), labels, slice_rows=40).collect()))


def test_quality_is_preferred(spark):
    rows = [(i, "w " * 10, s) for i in range(3000) for s in [("a", "b")[i % 2]]]
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(3000)], "doc_id long, quality int")
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels).where("source = 'b'").collect()
    good, bad = (sum(r.taken for r in out if r.doc_id // 2 % 2 == q) for q in (1, 0))
    assert good > 1.8 * bad


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
