import random
import re
import tracemalloc
from collections import Counter
from hashlib import md5

import numpy as np
import pytest

from stavelight.llm import neardup as nd
from stavelight.llm.common import ALNUM, Words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        d, most = plain_distance(a, b), rng.randrange(16)
        assert nd.edit_distance(a, b, most) == (d if d <= most else None), (a, b, most)


def plain_similar(a, b):
    """Edit similarity of 0.8 by the whole table of distances, a row at a time; words that both have bound it from below."""
    n, m = max(len(a), len(b)), min(len(a), len(b))
    most = n // 5
    if not m or n - m > most or sum((Counter(a) & Counter(b)).values()) < n - most:
        return False
    b, at = np.array(b), np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(step - at) + at
    return row[-1] <= most


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows):
    """Class by row: connected components of exact copies and similar pairs, all compared."""
    words = [words_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and words[i] and (rows[i][1] == rows[j][1] or plain_similar(words[i], words[j])):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(rows))]


def test_against_brute_force(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    hot = fresh(60)
    rows = [(1, None), (2, ""), (3, "!!"), (4, "one two"), (5, "One, two!"), (6, "a " * 500), (7, "a " * 480)]
    n = 10
    for _ in range(14):
        base = fresh(rng.randrange(30, 200))
        if rng.random() < 0.4:
            base += hot
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            rows.append((n, " ".join(w)))
            n += 1
        rows.append((n, rows[-1][1]))
        n += 1
    for _ in range(40):
        rows.append((n, " ".join(fresh(15) + hot + fresh(5))))
        n += 1
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = sorted((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect())
    assert got == sorted(zip([i for i, _ in rows], brute(rows), strict=True))
    kept = nd.keep_one(df, nd.near_duplicates(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got}) and kept.columns == df.columns


def linked(spark, texts, keys, **more):
    """Classes, as sets of text numbers, that links() makes of hand-made buckets (lists of text numbers)."""
    node = lambda i: bytearray([i >> 8, i & 255])
    band = [int(np.log(len(words_of(t))) / np.log(nd.BAND)) for t in texts]
    buckets = spark.createDataFrame([(k, node(i), len(b), len(texts[i]), band[i]) for k, b in enumerate(keys) for i in b], "key long, node binary, n long, size long, band int")
    packs = spark.createDataFrame([(node(i), len(t), bytearray(nd.packed(t.encode()))) for i, t in enumerate(texts)], "node binary, size long, _z binary")
    label = {i: i for i in range(len(texts))}
    for r in nd.components(nd.links(buckets, packs, **more).where("star")).collect():
        label[int.from_bytes(r.node, "big")] = int.from_bytes(r.label, "big")
    return [label[i] for i in range(len(texts))]


def test_cut_short_texts_meet(spark):
    """A is similar to the leader L and to B, which is not similar to L."""
    rng = random.Random(3)
    texts, keys = [], []
    for g in range(8):
        w = [f"g{g}x{rng.randrange(10**6)}" for _ in range(1004)]
        texts += [" ".join(w[:n]) for n in (1004, 854, 694)]
        keys += [[3 * g, 3 * g + 1, 3 * g + 2], [3 * g, 3 * g + 1, 3 * g + 2, 3 * (g + 1) % 24]]
    assert linked(spark, texts, keys) == [i // 3 * 3 for i in range(24)]


def test_blocks_compare_whole_buckets(spark):
    """One hot bucket of chains of texts, each similar to its neighbours only, and of copies; over many blocks and in one."""
    rng = random.Random(4)
    texts = []
    for length in (1, 2, 3, 5, 9, 30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(length):
            texts.append(" ".join(w))
            w = w[8:] + [f"w{rng.randrange(10**6)}" for _ in range(8)]
    near = [f"n{i}" for i in range(90)]
    texts += [" ".join(near[:i] + ["odd"] + near[i:]) for i in range(25)]
    want = brute(list(enumerate(texts)))
    assert len(set(want)) == 7
    for block in (1200, 4000, nd.BLOCK):
        assert linked(spark, texts, [list(range(len(texts)))], block=block) == want


def test_a_group_of_thousands(spark):
    """Near copies of one text, many of which are not similar to each other, beside unrelated texts: classes as all pairs make them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(4500):
        w = list(base[: rng.randrange(66, 81)])
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + base[:20]) for _ in range(400)]
    texts = sorted(set(texts))
    near = {i for i, t in enumerate(texts) if not t.startswith("u")}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(df).collect()}
    # all near copies are a few edits from one of the base's beginnings, and those from each other; the rest share a quarter of their words
    assert {got[i] for i in near} == {min(near)} and all(got[i] == i for i in range(len(texts)) if i not in near) and len(near) > 3000


def test_memory_follows_the_texts(spark):
    """Thousands of distinct short texts with one passage, in one block: no table of pairs."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(8)]
    texts = [[f"x{rng.randrange(10**7)}" for _ in range(4)] + passage + [f"x{rng.randrange(10**7)}" for _ in range(4)] for _ in range(5000)]
    texts += [t[:3] + ["new"] + t[4:] for t in texts[:50]]
    words = [Words([" ".join(t).encode()], ALNUM).hash for t in texts]
    tracemalloc.start()
    got, stars = nd.connecting(words, list(range(len(words))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((min(p), max(p)) for p in got) == [(i, 5000 + i) for i in range(50)] == sorted(stars) and peak < 100e6


@pytest.mark.parametrize("size,share,least", [(60, 0.05, 0.97), (60, 0.1, 0.9), (200, 0.01, 1.0), (200, 0.05, 0.97), (200, 0.1, 0.9), (600, 0.03, 0.99), (600, 0.1, 0.9)])
def test_recall_of_texts_with_replaced_words(size, share, least):
    """Of pairs whose words are replaced at random, as many meet in a bucket; what meets is aligned and linked."""
    rng = random.Random(size)
    met = 0
    for _ in range(400):
        a = np.array([rng.getrandbits(63) for _ in range(size)], np.uint64)
        b = a.copy()
        b[rng.sample(range(size), round(share * size))] = [rng.getrandbits(63) for _ in range(round(share * size))]
        met += bool(set(nd.bucket_keys(nd.shingles(a))) & set(nd.bucket_keys(nd.shingles(b)))) and nd.similar(a, b)
    assert met >= least * 400


def test_hubs_that_share_buckets(spark):
    """Chains and stars around hubs that lead each other's buckets: all pairs of a bucket count, whoever led it."""
    rng = random.Random(6)
    texts = []
    for g in range(3):
        p = [f"g{g}p{i}" for i in range(200)]
        for j in range(4):
            q = [f"g{g}q{j}x{i}" for i in range(rng.randrange(40, 60))]
            base = p[30 * j :] + q
            texts += [" ".join(base[:n]) for n in (len(base), len(base) - 20, len(base) - 38, len(base) - 52)]
            texts += [" ".join(base + [f"r{k}x{i}" for i in range(n)]) for k, n in enumerate((12, 25, 45))]
    n = len(texts)
    groups = [list(range(n // 3 * g, n // 3 * (g + 1))) for g in range(3)]
    keys = [g for g in groups] + [sorted(rng.sample(g, 9) + [groups[(i + 1) % 3][0]]) for i, g in enumerate(groups) for _ in range(4)]
    assert linked(spark, texts, keys) == brute(list(enumerate(texts)))


def test_keep_one_keeps_a_row_of_each_class(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (7, c), (7, d), (8, c + " end"), (None, c), (9, "!!"), (9, "!!"), (None, "?"), (None, "?")]
    rows.append((90, " ".join(f"v{rng.randrange(99999)}" for _ in range(30_000))))
    df = spark.createDataFrame([(*r, "m", 1, "x") for r in rows], "doc_id long, text string, _md5 string, _copy int, Label string").repartition(3)
    assert all((r._md5, r._copy, r.Label) == ("m", 1, "x") for r in nd.keep_one(df, nd.near_duplicates(df)).collect())
    got = [(r.doc_id, r.text) for r in nd.keep_one(df, nd.near_duplicates(df)).collect()]
    first = min(((None, a), (None, a + " end")), key=lambda r: md5(r[1].encode()).hexdigest())
    assert sorted(got, key=str) == sorted([first, (None, b), (7, c), (7, d), (9, "!!"), rows[-1], (None, "?"), (None, "?")], key=str)


def test_sketch_follows_order():
    a = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = lambda b: np.mean(nd.order_min_hash(a, 256, 3) == nd.order_min_hash(b, 256, 3))
    assert same(a) == 1 and same(a[::-1].copy()) < 0.25 and 0.4 < same(np.append(a[:180], a[:20] + np.uint64(1))) < 0.95


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
