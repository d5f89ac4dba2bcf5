"""What keeps time and memory of a task in bounds on larger tables."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stavelight import queries
from stavelight.operators import features as A
from stavelight.operators import rolls as R
from stavelight.plans import encode as E
from stavelight.plans import generation, grammar
from stavelight.sources import edit, midi, smf
from stavelight.streaming import notes as S

NOTES = "piece_id int, track int, pitch int, start int, end int"


def notes(n=300, top=200):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        start = rng.randrange(top)
        out.append((rng.randrange(2), rng.randrange(2), rng.randrange(60, 63), start, start + rng.randrange(0, 40)))
    return out


def counted(spark, df):
    """df, and an accumulator of how many of its rows are read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def long_file(n=150_000):
    return smf.serialise([[(i, smf.message(0x90, i % 128, 1)) for i in range(n)], [(7, smf.message(0x91, 1, 1))]], 12)


def test_a_long_note_costs_two_rows(spark):
    rows = spark.createDataFrame([(1, 1, 60, 0, 90_000), (1, 1, 64, 10, 80_000)], NOTES)
    assert sorted((r.step, r.length, r.active) for r in A.active_runs(rows).collect()) == [(0, 10, 1), (10, 79_990, 2), (80_000, 10_000, 1)]


def test_runs_are_the_steps(spark):
    own = notes()
    want = {}
    for p, t, _, a, b in own:
        for s in range(a, b):
            want[p, t, s] = want.get((p, t, s), 0) + 1
    got = A.active_steps(spark.createDataFrame(own, NOTES)).collect()
    assert {(r.piece_id, r.track, r.step): r.active for r in got} == want and len(got) == len(want)


def test_cells_of_overlapping_notes_stand_once(spark, capsys):
    own = notes()
    df = R.roll(spark.createDataFrame(own, NOTES), bound=150)
    got = sorted(tuple(r) for r in df.select("piece_id", "track", "step", "pitch").collect())
    assert got == sorted({(p, t, s, k) for p, t, k, a, b in own for s in range(a, min(b, 150))})
    df.explain()
    assert "Aggregate" not in capsys.readouterr().out


def test_bars_meet_their_sketch_as_words(spark, capsys):
    df = R.roll_min_hash(R.bar_roll(spark.createDataFrame(notes(), NOTES)), [1, 2], 16)
    got = {(r.piece_id, r.track, r.bar): r.sketch for r in df.collect()}
    data = {}
    for p, t, k, a, b in notes():
        for s in range(a, b):
            data.setdefault((p, t, s // 48), np.zeros((48, 16), np.uint8))[s % 48, k // 8] |= 1 << k % 8
    assert got == {key: [int(R.xxh32_of_windows(x.ravel(), 16, s).min()) for s in (1, 2)] for key, x in data.items()}
    df.explain()
    assert "map_from_entries" not in capsys.readouterr().out


def test_a_file_in_one_pass_of_arrays():
    rng = random.Random(1)
    rows = sorted((rng.choice([0, 5, 200, 20_000, 3_000_000]) + rng.randrange(100), rng.randrange(1, 4), rng.randrange(128), rng.randrange(128)) for _ in range(200))
    heads = [b"\x00" + smf.tempo_message(120), *(b"\x00" + smf.message(0xC0 | i, 5) for i in range(4))]
    lists = [[(0, h[1:])] for h in heads]
    for tick, track, key, velocity in rows:
        lists[track].append((tick, smf.message(0x90 | track, key, velocity)))
    tick, track, key, velocity = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    assert smf.file_bytes(heads, track, tick, 0x90 | track, key, velocity, 12) == smf.serialise(lists, 12)
    with pytest.raises(ValueError):
        smf.file_bytes(heads, track, tick, 0x90 | track, key, velocity - 200, 12)


def test_messages_of_a_long_file_come_in_batches():
    parts = smf.file_batches("a", long_file())
    assert sum(p.num_rows for p in parts) == 150_003 and max(p.num_rows for p in parts) <= smf.ROWS
    bad = smf.file_batches("a", long_file()[:-5])
    assert [p.num_rows for p in bad] == [1] and bad[0].column(11)[0].as_py()


def test_text_of_a_long_file_keeps_numbers_only():
    data = long_file(50_000)
    tracemalloc.start()
    text = edit.to_binasc(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edit.from_binasc(text) == data and peak < 300 * 50_000


def test_small_bytes_stay_dealt_out(spark):
    tracks = spark.createDataFrame([(i, 1, 0, 10) for i in range(40)], "piece_id int, track int, instrument int, track_type int")
    events = spark.createDataFrame([(i, 1, 0, 90, 60) for i in range(40)], "piece_id int, track int, tick int, velocity int, pitch int")
    files = smf.to_bytes(tracks, events)
    assert files.rdd.getNumPartitions() > 4
    assert files.where("content is null").count() == 0


def test_midi_partitions_follow_the_messages(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.mid").write_bytes(b"MThd" + bytes(6 << 20))
    from pyspark.sql.types import StructType

    assert len(midi.MidiReader(StructType.fromDDL("tick long"), {"path": str(tmp_path)}).partitions()) == 3


def test_requests_are_dealt_out_and_draws_stay(spark):
    req = spark.range(20).coalesce(1).select(F.col("id").alias("piece_id"), F.lit(1).alias("n_tracks"), F.lit(1).alias("n_bars"), F.col("id").alias("seed"), F.lit('[{"TRACK": [10]}]').alias("controls"))
    out = generation.generate(req, "NEW_DURATION_ENCODER")
    assert out.rdd.getNumPartitions() > 4
    got = {r.piece_id: r.tokens for r in out.collect()}
    for seed in (0, 7):
        c, rng, want = generation.Constraint("NEW_DURATION_ENCODER", 1, 1, [{"TRACK": [10]}]), np.random.default_rng(seed), []
        while not c.finished():
            p = c.allowed() / c.allowed().sum()
            want.append(int(rng.choice(c.size, p=p)))
            c.update(want[-1])
        assert got[seed] == want


def test_excerpts_read_messages_once(spark):
    files = spark.createDataFrame([("a", smf.serialise([[(i, smf.message(0x90, 60, i % 2)) for i in range(100)]], 12))], "piece_id string, content binary")
    messages, seen = counted(spark, smf.decode(files, "piece_id"))
    assert edit.excerpt(messages, 1, 3).count() > 0
    assert seen.value == 101


def test_fills_are_resolved_from_one_pass(spark):
    kinds = ["PIECE_START", "FILL_IN_PLACEHOLDER", "BAR", "FILL_IN_PLACEHOLDER", "TRACK_END", "FILL_IN_START", "A", "B", "FILL_IN_END", "FILL_IN_START", "C", "FILL_IN_END", "FILL_IN_START", "D", "FILL_IN_END"]
    tokens, seen = counted(spark, spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "piece_id int, idx int, token_type string"))
    got = [r.token_type for r in E.resolve_fills(tokens).orderBy("idx").collect()]
    assert got == ["PIECE_START", "A", "B", "BAR", "C", "TRACK_END"] and seen.value == len(kinds)


def test_one_call_pairs_many_keys():
    rows = [(str(p), "0", "60", 10 * p + ms, ms, v, ms) for p in range(50) for ms, v in ((1, 80), (4, 0), (6, 70))]
    ready = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), S.EVENT, strict=True)], schema=S.EVENT)
    out, held = S.OpenNotes(None)._notes(S.EVENT.empty_table(), ready, 1000)
    assert len(out) == 50 and set(zip(out["start"], out["end"], out["velocity"])) == {(1, 4, 80)} and len(held) == 50
    out, held = S.OpenNotes(100)._notes(held, S.EVENT.empty_table(), 1000)
    assert len(out) == 50 and out["hanging"].all() and out["end"].isna().all() and len(held) == 0


def test_features_of_a_track_of_any_length(spark):
    rows = spark.createDataFrame([(1, 1, 60, 0, 150_000), (1, 1, 64, 100_000, 250_001)], NOTES)
    ends = spark.createDataFrame([(1, 1, 250_001)], "piece_id int, track int, max_tick int")
    f = A.track_features(rows, ends).first()
    assert (f.min_polyphony, f.max_polyphony, f.min_polyphony_q, f.max_polyphony_q, f.max_polyphony_hard) == (1, 2, 1, 2, 1)
    assert abs(f.av_polyphony - 300_000 / 250_000) < 1e-9 and abs(f.silence - 1 / 250_001) < 1e-9
    told = A.polyphony_distribution(rows, ends).first().polyphony_distribution
    assert told == [1] * 100_000 + [2] * 50_000 + [1] * 100_000


def test_bar_rolls_of_files_of_any_length(spark):
    rng = random.Random(4)
    # signatures that cut bars short, notes of one pitch over each other, notes beyond 50,000 steps
    first = [(0, smf.signature_message(4, 4)), (50, smf.signature_message(7, 8)), (51, smf.signature_message(3, 4)), (400, smf.signature_message(4, 4))]
    ticks = [(s, s + rng.randrange(1, 400)) for s in [*(rng.randrange(600) for _ in range(30)), *(rng.randrange(59_000, 60_000) for _ in range(30))]]
    events = sorted((t, on, 60 + i % 3) for i, (a, b) in enumerate(ticks) for t, on in ((a, 90), (b, 0)))
    data = smf.serialise([first, [(t, smf.message(0x90, p, on)) for t, on, p in events]], 12)
    m = smf.decode(spark.createDataFrame([("a", data)], "piece_id string, content binary"), "piece_id")
    own, bars = R._file_notes(m, 12)[0].collect(), R.file_bars(m).collect()
    want = {(n.track, b.bar, s - b.bar_start, n.pitch) for n in own for b in bars for s in range(max(n.start, b.bar_start), min(n.end, b.bar_start + b.steps))}
    got = [(r.track, r.bar, r.step, r.pitch) for r in R.bar_roll_of_file(m).collect()]
    assert set(got) == want and len(got) == len(want) and max(b for _, b, _, _ in got) > 1200


def test_generated_pieces_are_checked_again(spark, monkeypatch):
    name = "NEW_DURATION_ENCODER"
    by_kind = {r[1]: r[0] for r in generation.rows_of(generation.get_encoder(name).domains) if r[6]}
    rng = random.Random(6)
    lists = [[], [by_kind["BAR"]], [by_kind[k] for k in ("PIECE_START", "TRACK", "INSTRUMENT", "NOTE_ONSET", "BAR_END", "TRACK_END")], [by_kind["BAR_END"], 9999, by_kind["BAR"]], *([rng.choice([*by_kind.values()]) for _ in range(40)] for _ in range(5))]
    of = {v: k for k, v in by_kind.items()}
    want = {i: sum((of.get(a), of.get(b)) not in grammar.edges(name, False) for a, b in zip(x, x[1:], strict=False)) for i, x in enumerate(lists)}
    rows = spark.createDataFrame([*((i, x, None) for i, x in enumerate(lists)), (99, [], "not finished")], "piece_id long, tokens array<int>, error string")
    whole = {r.piece_id: r for r in queries.generated_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert all((r.violations is None) == (r.error is not None) and not r.violations for r in whole.values()) and any(r.violations == 0 for r in whole.values())
    monkeypatch.setattr(generation, "generate", lambda *_: rows)
    got = {r.piece_id: r.violations for r in queries.generated_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert got == want | {99: None} and want[2] == 2 and want[3] == 2
