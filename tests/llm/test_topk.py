import math
import random

from stavelight.llm import topk


def brute(rows, k, every):
    code = lambda e: sum(1 << i for i, x in enumerate(e[:64]) if x is not None and x > 0)
    pts = sorted({(i, code(e)) for i, e in rows if i is not None and e is not None})
    out = []
    for q, c in pts:
        if q % every == 0:
            near = sorted({((c ^ d).bit_count(), i) for i, d in pts if i != q})[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(i, list(centres[0])) for i in range(400, 520)] + [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(520, 560)]
    rows += [(None, centres[1]), (600, None), (620, []), (640, [1.0, None]), rows[0], rows[20]]
    df = spark.createDataFrame([(i, e, "c") for i, e in rows], "vec_id long, embedding array<float>, code string").repartition(3)
    for ring in (4096, 3):
        got = sorted(tuple(r) for r in topk.top_k(df, 5, 20, ring=ring).collect())
        assert got == brute(rows, 5, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 1, 1)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_rings_answer_without_a_scan(spark, monkeypatch):
    """Codes in clusters of near ones, and the registered query: no query is left for the scan."""

    def refused(*_):
        raise AssertionError("scanned")

    monkeypatch.setattr(topk, "_scan", refused)
    rng = random.Random(1)
    codes = [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in (rng.getrandbits(64) for _ in range(500)) for _ in range(40)]
    vectors = [[1.0 if c >> i & 1 else -1.0 for i in range(64)] for c in codes]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(4)
    got = topk.top_k(df, 5, 100).collect()
    assert len(got) == 1000 and max(r.distance for r in got) <= 4
    from stavelight.llm.queries import op9_exact_top_k

    assert op9_exact_top_k(spark, "/root/testdata/sf0.001").count() == 250


def test_masks():
    for width, r in ((9, 0), (9, 3), (20, 2), (3, 4)):
        some = [int(x) for block in topk.masks(width, r, 7) for x in block]
        assert len(some) == len(set(some)) == math.comb(width, r) and all(x.bit_count() == r and x < 1 << width for x in some)


def test_long_vectors_use_their_first_elements(spark):
    df = spark.createDataFrame([(i, [1.0] * 64 + [float(i)] * i) for i in range(4)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.distance) for r in topk.top_k(df).collect()) == [(1, 0), (2, 0), (3, 0)]
