import random

import pytest
from pyspark.sql import functions as F

from stavelight.functions import gm
from stavelight.operators import features as A
from stavelight.operators import pieces as P
from stavelight.operators import rolls as R
from stavelight.operators import segments as G
from stavelight.plans import facade, generation, grammar, reader
from stavelight.sources import edit, smf, tables

ENCODER = "NEW_DURATION_ENCODER"


@pytest.fixture(scope="module")
def files(spark):
    rng, out = random.Random(1), []
    for p in range(3):
        tracks = [[(0, smf.tempo_message(120)), (0, smf.signature_message(4, 4))]]
        for c in range(3):
            ch = 9 if c == 2 else c
            rows = [(0, smf.message(0xC0 | ch, 5 * c))]
            for t in range(0, 48 * 16, 12):
                k, d = rng.randrange(40, 80), rng.randrange(3, 12)
                rows += [(t, smf.message(0x90 | ch, k, 90)), (t + d, smf.message(0x80 | ch, k, 0))]
            tracks.append(rows)
        out.append((f"f{p}", bytearray(smf.serialise(tracks, 12))))
    return spark.createDataFrame([*out, ("bad", bytearray(b"MThd"))], "path string, content binary").repartition(2)


@pytest.fixture(scope="module")
def piece(files):
    return facade.midi_to_piece(files)


def test_files_json_and_tokens_agree(files, piece):
    assert [r.piece_id for r in piece["errors"].collect()] == ["bad"]
    sequences = facade.E.sequences(facade.piece_to_tokens(piece, ENCODER))
    want = {r.piece_id: r.tokens for r in sequences.collect()}
    assert len(want) == 3 and all(len(x) > 500 for x in want.values())
    js = facade.piece_to_json(piece)
    assert {r.piece_id: r.tokens for r in facade.json_to_tokens(js, ENCODER).collect()} == want
    midi = facade.tokens_to_midi(sequences, ENCODER).withColumnRenamed("piece_id", "path")
    assert {r.piece_id: r.tokens for r in facade.midi_to_tokens(midi, ENCODER).collect()} == want
    one = smf.decode(facade.json_track_to_midi(js, 1), "piece_id")
    assert {r.n for r in one.where("status >= 144 and status < 160 and p2 > 0").groupBy("piece_id").agg(F.count("*").alias("n")).collect()} == {64}
    content = facade.json_bytes(piece, 4, 1, "rock").collect()
    assert all(r.content.endswith(b'"genre":"rock"}') for r in content) and all(len(r.content) == 0 for r in facade.json_bytes(piece, 4, 9).collect())


def test_readers(piece):
    o = reader.Options(seed=3)
    rows = reader.load_segment(piece, ENCODER, o).collect()
    assert not [r for r in rows if r.problem] and {r.piece_id for r in rows} == {"f0", "f1", "f2"}
    assert all(sum(r.token_type == "BAR" for r in rows if r.piece_id == f"f{i}") == 12 for i in range(3))
    pairs = reader.load_piece_pairs(piece, ENCODER, o).collect()
    assert len(pairs) == 3 and all(len(r.a) >= len(r.b) for r in pairs)
    assert reader.load_piece(piece, ENCODER, "f1", o).collect()[0].tokens == [r.token for r in sorted((r for r in rows if r.piece_id == "f1"), key=lambda r: r.idx)]
    many = reader.read_batches_of_lengths(piece, "MULTI_LENGTH_ENCODER", 2, o).collect()
    assert len(many) == 3 and all(len(r.tokens) == len(r["mask"]) for r in many)
    n = piece["events"].where("velocity > 0").select("piece_id", "track", "bar", "pitch", F.col("time").alias("start"), (F.col("time") + 3).alias("end"))
    features = A.bar_features(n, n.select("piece_id", "track", "bar").distinct().withColumn("max_tick", F.lit(48)))
    for r in reader.read_batches_with_features(piece, "TRACK_NOTE_DURATION_CONT_ENCODER", 2, features, reader.Options(max_seq_len=50)).collect():
        assert len(r.tokens) == len(r.embeddings) == 50 and all(len(x) == 3 for x in r.embeddings) and any(any(x) for x in r.embeddings)


def test_rolls_of_files(files):
    m = smf.decode(files)
    bars = R.bar_roll_of_file(m)
    assert bars.agg(F.max("bar"), F.max("step")).first()[:] == (15, 46)
    four = R.roll_of_file(m, 12, 4, 1).where("piece_id = 'f0'")
    want = bars.where("piece_id = 'f0' and bar between 1 and 4").select(((F.col("bar") - 1) * 48 + F.col("step")).alias("step"), "pitch").distinct()
    assert P.difference(four.select("step", "pitch"), want).count() == 0
    assert R.roll_of_file(m).groupBy("piece_id").count().count() == 3


def test_editing(spark, files):
    m = smf.decode(files).where("error is null").cache()
    size = {r.piece_id: r[1:] for r in edit.counts(m).collect()}
    assert all(x[0] == 4 for x in size.values())
    assert {r.tracks for r in edit.counts(edit.merge_tracks(m, 1, 2)).collect()} == {3} == {r.tracks for r in edit.counts(edit.delete_track(m, 1)).collect()}
    assert {r.tracks for r in edit.counts(edit.insert_tracks(m, 2, 1)).collect()} == {6}
    cat = edit.concatenate(m, spark.createDataFrame([("f0", "x", 0), ("f1", "x", 1)], "piece_id string, target string, position int"))
    assert edit.counts(cat).first().max_tick == size["f0"][2] + size["f1"][2]
    voices = edit.voice_counts(m).collect()
    assert len(voices) == 9 and all((r.onsets, r.offsets) == (64, 64) for r in voices)
    new = spark.createDataFrame([("f0", 1)], "piece_id string, smf_track int")
    built = [edit.note_on(5, 0, 61, 99), edit.note_off(9, 0, 61), edit.patch_change(0, 0, 7), edit.pitch_bend(1, 0, 0.0), edit.sustain_on(2, 0), edit.sustain_off(3, 0), edit.tempo(0, 120), edit.time_signature(0, 6, 8), edit.compound_time_signature(0, 6, 8), edit.text(4, "hé", "lyric"), edit.controller(4, 0, 1, 2)]
    rows = new.select("piece_id", "smf_track", F.explode(F.array(*built)).alias("m"))
    out = edit.order(edit.add(m, rows)).where("piece_id = 'f0'")
    assert edit.counts(out).first().events == size["f0"][1] + 11
    assert smf.lyrics(out).first().text == "hé" and [r.micros for r in smf.tempos(out).collect()] == [500000] * 2
    assert sorted((r.ts_num, r.ts_den) for r in smf.signatures(out).collect()) == [(4, 4), (6, 8), (6, 8)]
    assert [(r.p1, r.p2) for r in out.where("status = 224").collect()] == [(0, 64)]
    assert edit.text_dump(out).where("line = '1 5 90 3d 63'").count() == 1
    assert edit.without_empty(smf.decode(files)).where("piece_id = 'bad'").count() == 0


def test_binasc(files):
    good = files.where("path <> 'bad'")
    for comments in (False, True):
        text = edit.binasc_dump(good.withColumnRenamed("content", "old"), "old", comments)
        assert edit.binasc_content(text).where("old = content").count() == 3
    assert P.difference(smf.decode(text.select("path", F.encode("binasc", "UTF-8").alias("content"))), smf.decode(good)).count() == 0
    assert edit.from_binasc("4d '60 2'120 2u'120 +a \"hi\" 1001,0011 01010101 v300 t120 p0 ; x\n/ y") == bytes([0x4D, 60, 0, 120, 120, 0]) + b"ahi" + bytes([0x93, 0x55]) + smf.write_vlq(300) + (500000).to_bytes(3, "big") + bytes([0, 64])
    with pytest.raises(ValueError):
        edit.from_binasc("zz")


def test_steps_are_generated(spark):
    piece = {"tracks": [{"track_type": 10, "instrument": 3}, {"track_type": 11, "instrument": 0}], "cells": {(t, b): [(6 * i, 60 + i, 5, 100) for i in range(3)] for t in range(2) for b in range(6)}}
    status = [{"selected": [False, True, False, False, True, True], "autoregressive": False}, {"selected": [False] * 6}]
    done = []
    out = generation.multi_step(piece, status, ENCODER, {"max_steps": 4000}, 5, callback=done.append)
    assert done[-1] == 1 and all(out["cells"][k] == piece["cells"][k] for k in piece["cells"] if not (k[0] == 0 and status[0]["selected"][k[1]]))
    assert any(out["cells"][(0, b)] != piece["cells"][(0, b)] for b in (1, 4, 5)) and piece["cells"][(0, 1)] == [(0, 60, 5, 100), (6, 61, 5, 100), (12, 62, 5, 100)]
    prompt = generation.autoregressive_prompt(piece, ENCODER, [0, 1], 0, 4)
    kinds = [generation.Constraint(ENCODER, 2, 4).rows[t][1] for t in prompt]
    assert all(p in grammar.edges(ENCODER, False) for p in zip(kinds, kinds[1:], strict=False))
    assert generation._cells(prompt, ENCODER) == {k: v for k, v in piece["cells"].items() if k[1] < 4}
    fill = next(r[0] for r in generation.rows_of(generation.get_encoder(ENCODER).domains) if r[1] == "FILL_IN_START")
    assert generation.infill_prompt([1, fill, 2, fill], ENCODER) == [1, fill] and generation.infill_prompt([1], ENCODER) == [1]
    own = generation.parse_status("TE_ENCODER", [{"track_type": 0, "instruments": [130, 2], "density_level": 3}, {"track_type": 12}])
    assert own[0] == {"TRACK": [0], "INSTRUMENT": [2], "DENSITY_LEVEL": [2], "NOTE_ONSET": [35, 36]} and own[1] == {"TRACK": [10, 11]}
    tracks = spark.createDataFrame([("a", 0, 10, 3), ("a", 1, 11, 0)], "piece_id string, track int, track_type int, instrument int")
    notes = spark.createDataFrame([("a", t, b, *n) for (t, b), ns in piece["cells"].items() for n in ns], "piece_id string, track int, bar int, time int, pitch int, duration int, velocity int")
    asked = generation.status_of_piece(tracks, 6).withColumn("selected", F.when(F.col("track") == 0, F.array(*[F.lit(x) for x in status[0]["selected"]])).otherwise(F.col("selected")))
    got = generation.generate_steps(tracks, notes, asked, spark.createDataFrame([("a", 6)], "piece_id string, n_bars int"), ENCODER, {"max_steps": 4000}, 5).collect()
    assert sorted((r.track, r.bar, r.time, r.pitch, r.duration) for r in got) == sorted((t, b, *n[:3]) for (t, b), ns in out["cells"].items() for n in ns)
    with pytest.raises(RuntimeError, match="not finished"):
        generation.sample(generation.Constraint(ENCODER, 2, 4), 1, 3)


def test_status_and_segments(spark):
    s = spark.createDataFrame([("a", 0, [True] * 4, True), ("a", 1, [False] * 4, False)], "piece_id string, track int, selected array<boolean>, autoregressive boolean")
    assert [(r.track, r.selected) for r in G.status_subset(s, 1, 3, [1]).collect()] == [(0, [False, False])]
    got = {r.track: (r.selected, r.autoregressive) for r in G.status_rehighlight(s, [(0, 1), (1, 3)]).collect()}
    assert got == {0: ([False, True, False, False], False), 1: ([False, False, False, True], False)}
    bars = spark.createDataFrame([("a", b) for b in range(10)], "piece_id string, bar int")
    assert sorted((r.segment, r.bar) for r in G.multi_segments(bars).collect()) == [(s, b) for s in range(2) for b in range(4)]


def test_validation(spark):
    pieces = spark.createDataFrame([(i, 0 if i == 1 else 12, 120) for i in range(6)], "piece_id int, resolution int, tempo int")
    bars = spark.createDataFrame([(i, t, b, 3 if (i, t, b) == (3, 1, 1) else 4, 4) for i in range(6) for t in range(2) for b in range(2) if (i, t, b) != (2, 1, 1)], "piece_id int, track int, bar int, ts_num int, ts_den int")
    events = spark.createDataFrame([(i, 0, 0, 48 if i == 4 else 3, 90, 200 if i == 5 else 60) for i in range(6)], "piece_id int, track int, bar int, time int, velocity int, pitch int")
    t = {"pieces": pieces, "bars": bars, "events": events}
    got = {r.piece_id: r.problem for r in P.validate(t).collect()}
    assert got == {1: "no resolution", 2: "tracks differ in bars", 3: "tracks differ in time signature", 4: "event outside its bar", 5: "pitch out of range"}
    ok = P.valid(t)
    assert [r.piece_id for r in ok["pieces"].collect()] == [0] and ok["bars"].first().beat_length == 4
    for broken in (P.asserted(t)["pieces"], P.num_bars(bars)):
        with pytest.raises(Exception, match="tracks differ|no resolution|outside|range"):
            broken.collect()
    assert P.num_bars(bars.where("piece_id = 0")).first().n_bars == 2
    df = spark.createDataFrame([(1, True, 3), (1, False, 4), (2, None, 5)], "k int, b boolean, v int")
    assert {(r.k, r.any) for r in P.any_of(df, ["k"], "b").collect()} == {(1, True), (2, False)} and {(r.k, r["all"]) for r in P.all_of(df, ["k"], "b").collect()} == {(1, False), (2, True)}
    assert {(r.k, r.all_same, r.all_different) for r in P.sameness(df, ["k"], "v").collect()} == {(1, False, True), (2, True, True)}
    assert df.where(P.in_domain(F.col("v"), [3, 5])).count() == 2
    p = spark.createDataFrame([("a", 1.0, 2, 4), ("b", 9.0, 8, 4)], "piece_id string, temperature double, bars_per_step int, model_dim int")
    assert {(r.piece_id, r.field) for r in P.param_violations(p).collect()} == {("b", "temperature"), ("b", "model_dim")}


def test_instruments_and_tables(spark, tmp_path):
    assert gm.instruments("piano") == list(range(8)) and gm.instruments("drum_3") == [131] and gm.programs("drums") == list(range(128)) and gm.instruments("gunshot") == [127]
    assert gm.track_type_of("any") == 12 and gm.track_type_of("drums") == 11 and gm.track_type_of("violin") == 10 and gm.name_of(200) == "drum_72"
    with pytest.raises(ValueError):
        gm.instruments("nothing")
    df = spark.createDataFrame([(False, 40), (True, 5), (False, 8), (False, 300)], "d boolean, i int")
    assert [tuple(r) for r in df.select(gm.name_column(F.col("d"), F.col("i")), gm.family_column(F.col("d"), F.col("i"))).collect()] == [("violin", "strings"), ("drum_5", "drums"), ("celesta", None), (None, None)]
    (tmp_path / "ts.csv").write_text('TIME SIGNATURE,COUNT\n"""4/4""",9\n"""3/4""",5\n"""7/8""",5\n')
    counts = tables.signature_counts(spark, str(tmp_path / "ts.csv"))
    assert [(r.place, r.signature, r.n) for r in tables.most_frequent(counts, 2).orderBy("place").collect()] == [(0, "4/4", 9), (1, "3/4", 5)]
    (tmp_path / "g.tsv").write_text("id\tgenre\n1\trock---pop\n2\tjazz\n3\trock\n")
    assert [(r.number, r.genre) for r in tables.genres(spark, str(tmp_path / "g.tsv")).orderBy("number").collect()] == [(0, "NONE"), (1, "jazz"), (2, "rock")]
    (tmp_path / "d.json").write_text('{"instrument": 3, "quantiles": [1, 2]}\n')
    assert tables.density_deciles(spark, str(tmp_path / "d.json"), ["instrument"]).first().quantiles == [1, 2]
    assert "  BAR -> BAR_END;" in grammar.dot("TRACK_ENCODER")
