"""Hard negatives against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest

from stavelight.llm import negatives as N
from stavelight.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, k=5, m=10):
    rows = {(i, lab, tuple(math.floor(256 * c) for c in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i)
        for s, p, other in [x for x in near if x[2] == lab][:k]:
            fit = [(j, -t) for t, j, o in near if o != lab and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(fit[:m])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in N.mine(df, **options).select(*COLUMNS).collect())


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(N.ORACLE)
    got = Q.op11_hard_negatives(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == sorted(want.select(*COLUMNS).fetchall()) and len(want) > 100


def clustered(rng, n, dim=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 8]], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("block,group", [(40, 8), (7, 2), (2000, 500)])
def test_deep_trees_with_copies(spark, block, group):
    rng = random.Random(block)
    rows = clustered(rng, 600)
    rows += [(1000 + i, rows[3][1], 1) for i in range(300)]  # a third of all rows are copies of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert mined(df, every=20, block=block, group=group) == brute(rows, every=20)


def test_pruning_drops_pairs_of_blocks(spark):
    rows = clustered(random.Random(2), 800)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = N.as_integers(df.select(df.vec_id.alias("id"), df.label.cast("long").alias("label"), df.embedding.alias("v")), "v", 6, 256.0)
    trees = N.Trees(points, points.where("id % 20 = 0"), 800, 6, 20, 8)
    wanted = trees.anchors.selectExpr("block as a_block", "400000L as least", "1000000000L as most")
    found = {(r.a_block, r.c_block) for r in trees.pairs(wanted).collect()}
    a, c = ({r.block: np.frombuffer(r.x, np.int64).reshape(-1, 6) for r in t.collect()} for t in (trees.anchors, trees.candidates))
    need = {(i, j) for i, x in a.items() for j, y in c.items() if (x @ y.T).max() >= 400000}
    assert need and need <= found and len(found) < 0.5 * len(a) * len(c)


def test_odd_rows(spark):
    rng = random.Random(7)
    rows = clustered(rng, 60)
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(0, rows[1][1], 1), (0, rows[1][1], 2)]  # repeated rows; an id with several vectors and labels
    rows += [(61, None, 1), (62, [1.0] * 5 + [None], 1), (63, [math.nan] * 6, 1), (64, [math.inf] * 6, 1), (None, rows[2][1], 1), (65, rows[2][1], None)]
    other = [(200, [1.0], 1), (300, [], 1), (400, [1e300] * 6, 1)]
    df = spark.createDataFrame([(v, i, lab, "x", 7) for i, v, lab in [*rows, *other]], "embedding array<double>, vec_id long, label int, id string, rank int")
    assert mined(df, every=20) == brute(rows, every=20)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 61")) == [] and mined(df.where("vec_id % 100 = 7")) == []
    assert N.mine(df.limit(0)).columns == COLUMNS
