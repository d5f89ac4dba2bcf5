"""Validation that a schema drives, device segments, density tables, point look-ups."""

import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from stavelight.operators import features as A
from stavelight.operators import schemas as V
from stavelight.operators import segments as G
from stavelight.sources import dataset


def test_ranges_of_a_schema(spark):
    kind = "struct<tracks:array<struct<instrument:int,bars:array<struct<events:array<int>,tsNumerator:int,tsDenominator:int,internalBeatLength:float>>>>,tempo:int,resolution:int>"
    rows = [
        (1, ([(5, [([0, 1], 4, 4, -1.0)])], 120, 12)), (2, ([(128, [([0, -1], None, 4, 0.0)]), (None, None)], 0, 13)), (3, None), (4, (None, None, 1)), (5, ([None, (-1, [None])], 1, 1)),
    ]
    df = spark.createDataFrame(rows, f"id int, piece {kind}")
    got = sorted((r.id, r.path, r.value) for r in V.out_of_range(df, "piece", V.PIECE, ["id"]).collect())
    assert got == [
        (2, "piece.resolution", 13.0), (2, "piece.tempo", 0.0), (2, "piece.tracks[0].bars[0].events[1]", -1.0), (2, "piece.tracks[0].bars[0].tsNumerator", 0.0), (2, "piece.tracks[0].instrument", 128.0),
        (4, "piece.tempo", 0.0), (5, "piece.tracks[1].instrument", -1.0),
    ]
    # nulls pass, internal fields don't
    got = sorted((r.id, r.path) for r in V.out_of_range(df, "piece", V.PIECE, ["id"], unset=None).collect())
    assert got == [(2, "piece.resolution"), (2, "piece.tempo"), (2, "piece.tracks[0].bars[0].events[1]"), (2, "piece.tracks[0].instrument"), (5, "piece.tracks[1].instrument")]
    own = StructType([V.within("x", ArrayType(ArrayType(FloatType())), 0, 1), V.within("internalY", IntegerType(), 5, 6), V.within("gone", IntegerType(), 0, 1)])
    other = spark.createDataFrame([([[0.5, 2.0], [float("nan")]], 9)], "x array<array<float>>, internalY int").selectExpr("struct(x, internalY) as s")
    assert [r.path for r in V.out_of_range(other, "s", own, []).collect()] == ["s.x[0][1]", "s.x[1][0]"]
    assert [r.path for r in V.out_of_range(other, "s", own, [], skip="-").collect()] == ["s.x[0][1]", "s.x[1][0]", "s.internalY"]


def test_device_tracks_have_different_types(spark):
    rng = random.Random(1)
    types = [(p, t, rng.choice([[0], [1], [4], [6, 5, 7], [5, 6], [13], [9], [3]])) for p in range(12) for t in range(10)]
    df = spark.createDataFrame(types, "piece_id int, track int, train_types array<int>")
    segments = spark.createDataFrame([(p, s, list(range(10))) for p in range(11) for s in (0, 4)], "piece_id int, start int, tracks array<int>")
    out = G.select_segments_opz(segments, df, 3, 2).collect()
    again = G.select_segments_opz(segments.repartition(3), df.repartition(2), 3, 2).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and {r.start for r in out} == {0, 4, None}
    allowed = {(p, t): ts for p, t, ts in types}
    for r in out:
        if r.piece_id == 11:
            assert r.problem == "no valid segments" and r.tracks is None
            continue
        assert r.problem is None and len({x.track_type for x in r.tracks}) == len(r.tracks) == len({x.track for x in r.tracks})
        assert all(x.track_type in allowed[r.piece_id, x.track] and x.track_type < 8 for x in r.tracks)
        used = {x.track_type for x in r.tracks}  # no track that was left out could have had a free type
        assert all(set(t for t in allowed[r.piece_id, k] if t < 8) <= used for k in range(10) if k not in {x.track for x in r.tracks})
    few = G.select_segments_opz(segments, df, 3, 9).where("piece_id < 11").collect()
    assert {(r.problem, r.tracks) for r in few} == {("less than min tracks", None)}


def test_density_tables(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(16), rng.randrange(3), rng.choice([0, 1, 1, 2, 3, 5, 8, 40])) for _ in range(3000)]
    got = {(r.track_type, r.program): (list(r.quantiles), list(r.first_equal)) for r in A.density_tables(spark.createDataFrame(rows, "track_type int, instrument int, n int")).collect()}
    want = {}
    for kind, inst, n in rows:
        if n:
            want.setdefault((None, 128 if kind in (0, 1, 2, 8, 11) else inst), []).append(n)
            for key in [(k, p) for k in (0, 1, 2) for p in range(128)] if kind <= 2 else [(kind, inst)] if kind <= 7 else []:
                want.setdefault(key, []).append(n)
    assert set(got) == set(want)
    for k, v in want.items():
        q = [int(x + 1e-9) for x in np.quantile(v, np.arange(1, 10) / 10)] + [1 << 30]
        assert got[k] == (q, [q.index(x) for x in q])


def test_a_look_up_reads_one_row_group(spark, tmp_path):
    rows = spark.range(0, 60_000, 3).selectExpr("id as row_id", "cast(id % 10 = 0 as int) as split", "sha2(cast(id as string), 512) as body")
    path = str(tmp_path / "set")
    dataset.append(rows.repartition(7), path, row_group=100_000)
    files = [f for f in (tmp_path / "set" / "split=train").glob("*.parquet")]
    groups = sum(pq.ParquetFile(f).num_row_groups for f in files)
    assert groups > 8

    def scanned(df):
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return [r.row_id for r in found], plan.metrics().apply("numOutputRows").value()

    one = max(pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups))
    ids, read = scanned(dataset.lookup(spark, path, "train", [30_003]))
    assert ids == [30_003] and read <= one < 18_000
    ids, read = scanned(dataset.lookup(spark, path, "train", [30_004]))  # within the statistics' range, so the Bloom filter excludes it
    assert ids == [] and read == 0
    assert dataset.read(spark, path, "valid", 30_000).count() == 1 and dataset.sizes(spark, path).count() == 2
