"""Switches, excerpts, order of messages, melody, mixing of pitches, by hand."""

from pyspark.sql import functions as F

from stavelight.operators import notes as N
from stavelight.sources import edit, smf

COLUMNS = [f.split()[0] for f in smf.SCHEMA.split(", ")]


def table(spark, rows, tpq=480):
    """rows: piece, track, seq, tick, status, p1, p2[, meta type, meta]."""
    full = [(p, tpq, t, s, k, st, st & 15 if st < 240 else None, a, b, *(more or (None, None)), None) for p, t, s, k, st, a, b, *more in rows]
    return spark.createDataFrame(full, smf.SCHEMA)


def test_switches(spark):
    values = [0, 10, 64, 127, 63, 0, 70, 80, 3, 99]  # off before any on, on, on again, off, off again, on, on, off, on for ever
    rows = [("a", 0, i, 10 * i, 0xB2, 64, v) for i, v in enumerate(values)]
    rows += [("a", 0, 20, 200, 0xB2, 1, 127), ("a", 0, 21, 210, 0xB2, 1, 0), ("a", 0, 22, 220, 0xB3, 122, 64), ("a", 1, 23, 230, 0xB3, 122, 0), ("a", 0, 24, 240, 0x92, 64, 127)]
    got = sorted(tuple(r) for r in N.link_switches(table(spark, rows)).collect())
    assert got == [("a", 0, 2, 64, 2, 4, 20, 40), ("a", 0, 2, 64, 6, 8, 60, 80)]
    assert [r.on_seq for r in N.link_switches(table(spark, rows), 128).collect()] == []


def test_excerpt_carries_the_state_in_force(spark):
    tempo = lambda bpm: (255, None, None, 81, bytearray(round(6e7 / bpm).to_bytes(3, "big")))
    rows = [
        ("a", 0, 0, 0, *tempo(120)), ("a", 0, 1, 480, *tempo(60)), ("a", 0, 2, 2400, *tempo(240)),
        ("a", 1, 3, 0, 0xC0, 5, 0), ("a", 1, 4, 100, 0xC0, 7, 0), ("a", 1, 5, 100, 0xB0, 7, 100), ("a", 1, 6, 300, 0xB0, 7, 90), ("a", 1, 7, 300, 0xB1, 10, 1),
        ("a", 1, 8, 400, 0x90, 60, 64), ("a", 1, 9, 1000, 0x80, 60, 0),  # sounds at the start
        ("a", 1, 10, 1000, 0x90, 62, 64), ("a", 1, 11, 1200, 0x80, 62, 0), ("a", 1, 12, 2000, 0x90, 64, 64), ("a", 1, 13, 3000, 0x80, 64, 0),  # within, and over the end
        ("a", 1, 14, 3000, 255, None, None, 47, bytearray()),
    ]
    m = table(spark, rows)
    # at 60 a quarter is a second: 480 ticks are half a second, so second 1.0 is tick 720 and second 4.75 is tick 2400 + 480
    out = edit.excerpt(m, 1.0, 4.75)
    assert out.columns == COLUMNS
    got = [(r.smf_track, r.tick, r.status, r.p1, r.p2) for r in out.orderBy("seq").collect()]
    assert got == [
        (0, 0, 255, None, None), (0, 1680, 255, None, None), (1, 0, 0xC0, 7, 0), (1, 0, 0xB0, 7, 90), (1, 0, 0xB1, 10, 1),
        (1, 280, 0x90, 62, 64), (1, 480, 0x80, 62, 0), (1, 1280, 0x90, 64, 64), (1, 2160, 0x80, 64, 64),
    ]
    key = F.concat_ws(":", "status", "p1", "meta_type")
    before = {r.k: r.seconds for r in smf.with_seconds(m).where("tick between 720 and 2879").select(key.alias("k"), "seconds").collect()}
    after = {r.k: r.seconds for r in smf.with_seconds(out).where("tick > 0").select(key.alias("k"), "seconds").collect()}
    assert set(before) - {"128:60"} <= set(after) and all(abs(after[k] - before[k] + 1.0) < 1e-9 for k in before if k != "128:60")
    late = edit.excerpt(m, 100, 200)
    assert [r.tick for r in late.collect()] == [0, 0, 0, 0] and edit.excerpt(m, 0, 0).count() == 0
    nine = edit.excerpt(table(spark, [("a", 0, 0, 0, 0x90, 60, 64), ("a", 0, 1, 10, 0x90, 60, 0), ("a", 0, 2, 20, 0x90, 61, 64)]), 0, 1)
    assert [(r.tick, r.status, r.p2) for r in nine.orderBy("seq").collect()][-1] == (960, 0x90, 0)


def test_order_of_messages(spark):
    rows = [("a", 0, 0, 5, 255, None, None, 47, bytearray()), ("a", 0, 1, 5, 0x90, 60, 1), ("a", 0, 2, 5, 0x90, 61, 0), ("a", 0, 3, 5, 0xB0, 9, 1), ("a", 0, 4, 5, 0xB0, 7, 3), ("a", 0, 5, 5, 0xB1, 7, 2), ("a", 0, 6, 5, 255, None, None, 1, bytearray(b"x")), ("a", 0, 7, 5, 0x80, 1, 1)]
    m = table(spark, rows).withColumn("old", F.col("seq"))
    assert [r.old for r in edit.order(m).orderBy("seq").collect()] == [6, 3, 4, 5, 2, 7, 1, 0]
    assert [r.old for r in edit.order(m, keep=False).orderBy("seq").collect()] == [6, 5, 4, 3, 2, 7, 1, 0]


def test_melody(spark):
    rows = [(0, 60, 4), (0, 64, 2), (0, 62, 9), (2, 50, 3), (5, 70, 9), (6, 55, 8)]  # start, pitch, end
    n = spark.createDataFrame([(1, 0, p, s, e) for s, p, e in rows], "piece_id int, track int, pitch int, start int, end int")
    got = [(r.start, r.pitch) for r in N.melody(n).orderBy("start").collect()]
    # 64 ends where 50 begins; a rest from 3 to 5; 55 cuts 70 off and ends at 8
    assert got == [(0, 64), (2, 50), (3, None), (5, 70), (6, 55), (8, None)]


def test_mixup(spark):
    rows = [(i % 3, i % 2, 40 + i % 7, i, i + 2, 64) for i in range(60)]
    n = spark.createDataFrame(rows, "piece_id int, track int, pitch int, start int, end int, velocity int")
    out = edit.mixup(n, 5)
    assert out.columns == n.columns
    pitches = lambda df: sorted((r.piece_id, r.pitch) for r in df.collect())
    rest = lambda df: sorted((r.piece_id, r.track, r.start, r.end, r.velocity) for r in df.collect())
    assert pitches(out) == pitches(n) and rest(out) == rest(n) and sorted(out.collect()) != sorted(n.collect()) and sorted(out.collect()) == sorted(edit.mixup(n, 5).collect())
    one = edit.mixup(n.where("piece_id = 0"), None).orderBy("track", "start").collect()
    plain = n.where("piece_id = 0").orderBy("track", "start").collect()
    assert [r.pitch for r in one] == [r.pitch for r in reversed(plain)]
