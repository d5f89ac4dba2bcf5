"""Pieces to token sequences, as one union of rows per level with a composite place.

Inputs are tables: tracks (piece_id, track, track_type, instrument and whatever features the encoder marks), bars (piece_id, bar, ts_num, ts_den) shared by
a piece's tracks, events (piece_id, track, bar, time, velocity, pitch[, duration]; time is relative to the bar). The result is a row per token; one
window by piece numbers them. ``sequences`` collects arrays at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import spread
from .vocab import Encoder, get_encoder, rows_of, token_of

PLACE = ["p1", "p2", "p3", "p4", "p5", "p6", "p7"]
KEY = ["piece_id", "track"]


def _size(e: Encoder, kind: str) -> int:
    return len({r[0] for r in rows_of(e.domains) if r[1] == kind})


def _row(df: DataFrame, e: Encoder, kind: str, value: Column, place: list[Column]) -> DataFrame:
    return df.select("piece_id", *[x.cast("long").alias(n) for n, x in zip(PLACE, place, strict=True)], F.lit(kind).alias("token_type"), value.cast("int").alias("value"), token_of(e.name, kind, value).alias("token"))


def _spec(e: Encoder, kind: str, value: Column, place: list[Column], when: Column | None = None, token: Column | None = None) -> Column:
    """A token of a row as a struct, null where ``when`` doesn't hold."""
    x = F.struct(*[p.cast("long").alias(n) for n, p in zip(PLACE, place, strict=True)], F.lit(kind).alias("token_type"), value.cast("int").alias("value"), (token_of(e.name, kind, value) if token is None else token).cast("int").alias("token"))
    return F.when(F.lit(True) if when is None else when, x)


def _exploded(df: DataFrame, tokens: list[Column]) -> DataFrame:
    return df.select("piece_id", F.explode(F.array_compact(F.array(*tokens))).alias("t")).select("piece_id", "t.*")


def time_tokens(rows: DataFrame, keys: list[str], order: list[str], absolute: bool, domain: int) -> DataFrame:
    """rows with ``clock``: the values of the time tokens before each row. The clock of a group starts at 0.

    absolute: one token of the time itself where time moves on; else the gap, in pieces of at most ``domain`` steps, each less one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col("time") - F.coalesce(F.lag("time").over(w), F.lit(0))
    df = rows.withColumn("_gap", gap)
    whole, none = F.floor((F.col("_gap") - 1) / domain).cast("int"), F.array().cast("array<int>")
    split = F.concat(F.array_repeat(F.lit(domain - 1), whole), F.array((F.col("_gap") - whole * domain - 1).cast("int")))
    value = F.array(F.col("time").cast("int")) if absolute else split
    return df.withColumn("clock", F.when(F.col("_gap") > 0, value).otherwise(none)).drop("_gap")


def event_tokens(events: DataFrame, e: Encoder, place: list[Column]) -> DataFrame:
    """Token rows of all bars. events: KEY, bar, time, velocity, pitch, is_drum, duration in duration mode, and seq."""
    c = e.config
    bar = [*KEY, "bar"]
    if c.use_note_duration_encoding:
        rows = events.where("velocity > 0 and duration > 0")
    else:
        rows = events if c.use_drum_offsets else events.where("velocity > 0 or not is_drum")
    rows = rows.withColumn("on", F.least("velocity", F.lit(1)))
    order = ["time", "on", "pitch", "seq"]
    clock = "TIME_ABSOLUTE" if c.use_absolute_time_encoding else "TIME_DELTA"
    df = time_tokens(rows, bar, order, c.use_absolute_time_encoding, _size(e, clock))
    w = Window.partitionBy(*bar).orderBy(*order)
    # duration mode tells the velocity's level; event mode tells on or off, as its vocabulary has it
    level = S.velocity_level(F.col("velocity")) if c.use_note_duration_encoding else F.col("on")
    if c.use_velocity_levels:
        df = df.withColumn("_level", level).withColumn("_new", (F.col("_level") > 0) & ~F.col("_level").eqNullSafe(F.lag("_level").over(w)))
    df = df.withColumn("_i", F.row_number().over(w))
    token = lambda kind, v: F.struct(F.lit(kind).alias("k"), v.cast("int").alias("v"))
    parts = [F.transform("clock", lambda v: token(clock, v))]
    if c.use_velocity_levels:
        parts.append(F.when(F.col("_new"), F.array(token("VELOCITY_LEVEL", F.col("velocity") if c.use_note_duration_encoding else F.col("on")))).otherwise(F.array().cast("array<struct<k:string,v:int>>")))
    pitch = S.transpose(F.col("pitch"), F.col("is_drum"), F.lit(c.transpose))
    if c.use_note_duration_encoding:
        parts.append(F.array(token("NOTE_ONSET", pitch)))
        length = F.array(token("NOTE_DURATION", F.least("duration", F.lit(_size(e, "NOTE_DURATION"))) - 1))
        parts.append(length if c.use_drum_offsets else F.when(F.col("is_drum"), F.array().cast("array<struct<k:string,v:int>>")).otherwise(length))
    else:
        parts.append(F.array(F.when(F.col("on") == 1, token("NOTE_ONSET", pitch)).otherwise(token("NOTE_OFFSET", pitch))))
    df = df.select("*", F.posexplode(F.concat(*parts)).alias("_j", "_t"))
    kinds = [clock, "VELOCITY_LEVEL", "NOTE_ONSET", "NOTE_OFFSET", "NOTE_DURATION"]
    tok = None
    for k in kinds:
        if _size(e, k):
            x = token_of(e.name, k, F.col("_t.v"))
            tok = F.when(F.col("_t.k") == k, x) if tok is None else tok.when(F.col("_t.k") == k, x)
    at = [*place, F.col("_i"), F.col("_j")]
    return df.select("piece_id", *[x.cast("long").alias(n) for n, x in zip(PLACE, at, strict=True)], F.col("_t.k").alias("token_type"), F.col("_t.v").alias("value"), tok.alias("token"))


def encode(name: str, tracks: DataFrame, bars: DataFrame, events: DataFrame, fills: DataFrame | None = None, num_bars: bool = True) -> DataFrame:
    """(piece_id, idx, token_type, value, token, problem). fills (piece_id, track, bar): bars to leave out and tell at the end.

    problem names tokens outside the vocabulary and bars that need a time signature the encoder doesn't mark; nothing is dropped.
    """
    e = get_encoder(name)
    c, zero = e.config, F.lit(0)
    if c.unquantized or c.interleaved:
        raise NotImplementedError(f"{name}: use encode_interleaved" if c.interleaved else f"{name} has no event tokens")
    drum = S.is_drum_track(F.col("track_type"))
    tracks = tracks.withColumn("is_drum", drum)
    grid = tracks.select(*KEY, "is_drum").join(bars, "piece_id")
    infill = fills is not None
    grid = grid.join(fills.select(*KEY, "bar", F.lit(True).alias("filled")), [*KEY, "bar"], "left").fillna(False, ["filled"]) if infill else grid.withColumn("filled", F.lit(False))
    start = [_spec(e, "PIECE_START", F.lit(1 if infill and _size(e, "PIECE_START") > 1 else 0), [zero] * 7)]
    if num_bars and _size(e, "NUM_BARS"):
        start.append(_spec(e, "NUM_BARS", F.col("n_bars"), [zero, zero, F.lit(1), *[zero] * 4]))
    pieces = bars.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n_bars"))
    # all tokens of a track's head from its one row
    head = lambda n: [F.lit(1), F.col("track"), zero, F.lit(n), zero, zero, zero]
    own = [_spec(e, "TRACK", F.col("track_type"), head(0))]
    if c.mark_genre:
        m = F.create_map(*[F.lit(x) for r in rows_of(e.domains) if r[1] == "GENRE" for x in (r[3], r[0])])
        own.append(_spec(e, "GENRE", zero, head(1), token=F.try_element_at(m, F.col("genre"))))
    if c.mark_instrument:
        program = F.when(~F.col("is_drum"), S.instrument_group(F.col("instrument"), False)).otherwise(F.col("instrument")) if c.do_pretrain_map else F.col("instrument")
        own.append(_spec(e, "INSTRUMENT", program, head(2)))
    if _size(e, "PITCH_CLASS"):
        own += [_spec(e, "PITCH_CLASS", F.lit(i), [F.lit(1), F.col("track"), zero, F.lit(3), F.lit(i), zero, zero], ~F.col("is_drum") & F.col("pitch_classes")[i]) for i in range(12)]
    if c.mark_density or c.mark_drum_density:
        own.append(_spec(e, "DENSITY_LEVEL", F.col("density_bin"), head(4), None if c.mark_density else F.col("is_drum")))
    columns: list[tuple[str, Column]] = []
    if _size(e, "MIN_POLYPHONY_HARD"):
        rest = S.rest_token(F.col("rest_percentage"), _size(e, "REST_PERCENTAGE")) if "rest_percentage" in tracks.columns else zero
        columns = [(k, F.col(k.lower())) for k in ("MIN_POLYPHONY_HARD", "MAX_POLYPHONY_HARD", "MIN_NOTE_DURATION_HARD", "MAX_NOTE_DURATION_HARD")] + [("REST_PERCENTAGE", rest)]
    else:
        columns += [(k, F.col(k.lower())) for k in ("MIN_POLYPHONY", "MAX_POLYPHONY")] * c.mark_polyphony_quantile
        columns += [(k, F.col(k.lower())) for k in ("MIN_NOTE_DURATION", "MAX_NOTE_DURATION")] * c.mark_note_duration_quantile
    own += [_spec(e, k, v, head(5 + i), ~F.col("is_drum") if c.mark_drum_density else None) for i, (k, v) in enumerate(columns)]
    own.append(_spec(e, "TRACK_END", zero, [F.lit(1), F.col("track"), F.lit(2), *[zero] * 4]))
    at = lambda n: [F.lit(1), F.col("track"), F.lit(1), F.col("bar"), F.lit(n), zero, zero]
    cells = [_spec(e, "BAR", zero, at(0)), _spec(e, "BAR_END", zero, at(9))]
    if c.mark_time_sigs:
        m = F.create_map(*[F.lit(x) for r in rows_of(e.domains) if r[1] == "TIME_SIGNATURE" for x in (f"{r[4]}/{r[5]}", r[0])])
        cells.append(_spec(e, "TIME_SIGNATURE", F.col("ts_num") * 1000 + F.col("ts_den"), at(1), token=F.try_element_at(m, F.concat_ws("/", "ts_num", "ts_den"))))
    rows = events.join(tracks.select(*KEY, "is_drum"), KEY)
    if infill:
        rows = rows.join(fills.select(*KEY, "bar", F.lit(True).alias("filled")), [*KEY, "bar"], "left").fillna(False, ["filled"])
        back = lambda n: [F.lit(2), F.col("track"), F.col("bar"), F.lit(n), zero, zero, zero]
        cells += [_spec(e, k, zero, place, F.col("filled")) for k, place in (("FILL_IN_PLACEHOLDER", at(2)), ("FILL_IN_START", back(0)), ("FILL_IN_END", back(2)))]
        here, there = [F.lit(1), F.col("track"), F.lit(1), F.col("bar"), F.lit(3)], [F.lit(2), F.col("track"), F.col("bar"), F.lit(1), zero]
        of_events = event_tokens(rows, e, [F.when(F.col("filled"), y).otherwise(x) for x, y in zip(here, there, strict=True)])
    else:
        of_events = event_tokens(rows, e, [F.lit(1), F.col("track"), F.lit(1), F.col("bar"), F.lit(3)])
    all_rows = _exploded(pieces, start).unionByName(_exploded(tracks, own)).unionByName(_exploded(grid, cells)).unionByName(of_events)
    problem = F.when(F.col("token").isNull(), F.concat(F.col("token_type"), F.lit(": no such value")))
    if not c.mark_time_sigs:
        odd = bars.where(F.col("ts_num") * 4 != F.col("ts_den") * 4).select("piece_id").distinct().withColumn("_odd", F.lit(True))
        all_rows = all_rows.join(odd, "piece_id", "left")
        problem = F.coalesce(problem, F.when(F.col("_odd") & (F.col("token_type") == "PIECE_START"), "time signature other than 4/4"))
    idx = F.row_number().over(Window.partitionBy("piece_id").orderBy(*PLACE)) - 1
    return spread(all_rows, "piece_id").select("piece_id", idx.alias("idx"), "token_type", "value", "token", problem.alias("problem"))


def encode_interleaved(name: str, tracks: DataFrame, bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bar-major merge of all tracks: INSTRUMENT on change (128 more for drums), with the header's instruments first where the encoder has one."""
    e = get_encoder(name)
    zero = F.lit(0)
    own = S.gm_key(S.is_drum_track(F.col("track_type")), F.col("instrument"))
    rows = events.join(tracks.select(*KEY, own.alias("inst")), KEY).withColumn("on", F.least("velocity", F.lit(1)))
    order = ["time", "on", "inst", "pitch", "seq"]
    df = time_tokens(rows, ["piece_id", "bar"], order, False, _size(e, "TIME_DELTA"))
    w = Window.partitionBy("piece_id").orderBy("bar", *order)
    df = df.withColumns({"_new": ~F.col("inst").eqNullSafe(F.lag("inst").over(w)), "_i": F.row_number().over(w)})
    place = lambda n: [F.lit(1), F.col("bar"), F.lit(n), zero, zero, zero, zero]
    here = lambda n: [F.lit(1), F.col("bar"), F.lit(1), F.col("_i"), F.lit(n), zero, zero]
    pieces = bars.select("piece_id").distinct()
    out = [
        _row(pieces, e, "PIECE_START", zero, [zero] * 7), _row(bars, e, "BAR", zero, place(0)), _row(bars, e, "BAR_END", zero, place(2)),
        _row(df.select("*", F.posexplode("clock").alias("_j", "v")), e, "TIME_DELTA", F.col("v"), [F.lit(1), F.col("bar"), F.lit(1), F.col("_i"), zero, F.col("_j"), zero]),
        _row(df.where("_new"), e, "INSTRUMENT", F.col("inst"), here(1)), _row(df.where("on = 1"), e, "NOTE_ONSET", F.col("pitch"), here(2)), _row(df.where("on = 0"), e, "NOTE_OFFSET", F.col("pitch"), here(2)),
    ]
    if _size(e, "HEADER"):
        used = tracks.select("piece_id", own.alias("inst")).distinct()
        out += [_row(pieces, e, "HEADER", F.lit(v), [zero, F.lit(1 + 2 * v), *[zero] * 5]) for v in (0, 1)] + [_row(used, e, "INSTRUMENT", F.col("inst"), [zero, F.lit(2), F.col("inst"), *[zero] * 4])]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    idx = F.row_number().over(Window.partitionBy("piece_id").orderBy(*PLACE)) - 1
    return rows.select("piece_id", idx.alias("idx"), "token_type", "value", "token", F.when(F.col("token").isNull(), F.concat(F.col("token_type"), F.lit(": no such value"))).alias("problem"))


def sequences(tokens: DataFrame) -> DataFrame:
    """(piece_id, tokens) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "token")))
    return tokens.groupBy("piece_id").agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))


def strip_header(tokens: DataFrame) -> DataFrame:
    """Tokens outside HEADER pairs, renumbered."""
    w = Window.partitionBy("piece_id").orderBy("idx")
    n = F.sum((F.col("token_type") == "HEADER").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = tokens.withColumn("_n", n).where((F.col("_n") % 2 == 0) & (F.col("token_type") != "HEADER")).drop("_n")
    return df.withColumn("idx", F.row_number().over(w) - 1)


def resolve_fills(tokens: DataFrame) -> DataFrame:
    """Tokens with the k-th placeholder replaced by what the k-th FILL_IN_START .. FILL_IN_END holds, renumbered."""
    w = Window.partitionBy("piece_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda k: F.sum((F.col("token_type") == k).cast("int")).over(w)
    df = tokens.withColumns({"_s": count("FILL_IN_START"), "_e": count("FILL_IN_END")})
    # each row knows the places of its piece's placeholders, so nothing is joined and tokens are made once
    every = Window.partitionBy("piece_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = F.collect_list(F.when(F.col("token_type") == "FILL_IN_PLACEHOLDER", F.col("idx"))).over(every)
    inside = (F.col("_s") > F.col("_e")) & (F.col("token_type") != "FILL_IN_START")
    outside = (F.col("_s") == 0) & (F.col("token_type") != "FILL_IN_PLACEHOLDER")
    df = df.withColumn("_at", F.when(inside, F.try_element_at(places, F.greatest("_s", F.lit(1)).cast("int"))).when(outside, F.col("idx")))
    df = df.where("_at is not null").withColumn("_sub", F.when(inside, F.col("idx")).otherwise(F.lit(0)))
    idx = F.row_number().over(Window.partitionBy("piece_id").orderBy("_at", "_sub")) - 1
    return df.withColumn("_new", idx).drop("idx", "_s", "_e", "_at", "_sub").withColumnRenamed("_new", "idx")


def decode(tokens: DataFrame, resolution: int = 12, default_velocity: int = 100) -> DataFrame:
    """(piece_id, track, bar, time, velocity, pitch, duration, instrument, track_type): notes of a token table (piece_id, idx, token_type, v_int, v_num, v_den).

    Track and bar are running counts, time a running sum within the bar; the velocity is the last one told in the bar. In event mode an onset
    lasts to the pitch's next offset in its track. One sort by piece serves all windows.
    """
    piece = Window.partitionBy("piece_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda k: F.col("token_type") == k
    df = tokens.withColumn("track", F.sum(hit("TRACK").cast("int")).over(piece) - 1)
    track = Window.partitionBy("piece_id", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"bar": F.sum(hit("BAR").cast("int")).over(track) - 1, "track_type": F.first(F.when(hit("TRACK"), F.col("v_int")), True).over(track), "instrument": F.last(F.when(hit("INSTRUMENT"), F.col("v_int")), True).over(track)})
    bar = Window.partitionBy("piece_id", "track", "bar").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.sum(F.when(hit("TIME_DELTA"), F.col("v_int") + 1).otherwise(0)).over(bar)
    fixed = F.last(F.when(hit("TIME_ABSOLUTE"), F.col("v_int")), True).over(bar)
    velocity = F.last(F.when(hit("VELOCITY_LEVEL"), F.col("v_int")), True).over(bar)
    following = Window.partitionBy("piece_id", "track").orderBy("idx")
    df = df.withColumns({"time": F.coalesce(fixed, delta).cast("int"), "velocity": F.coalesce(velocity, F.lit(default_velocity)), "_kind": F.lead("token_type").over(following), "_value": F.lead("v_int").over(following)})
    beats = F.coalesce(F.last(F.when(hit("TIME_SIGNATURE"), F.col("v_num") / F.col("v_den") * 4), True).over(track), F.lit(4.0))
    df = df.withColumn("_len", F.floor(beats * resolution))
    starts = df.where(hit("BAR_END")).select("piece_id", "track", "bar", F.col("_len"))
    w = Window.partitionBy("piece_id", "track").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("bar_start", F.coalesce(F.sum("_len").over(w), F.lit(0))).drop("_len")
    notes = df.where(hit("NOTE_ONSET") | hit("NOTE_OFFSET")).join(starts, ["piece_id", "track", "bar"]).withColumn("_abs", F.col("bar_start") + F.col("time"))
    pitch = Window.partitionBy("piece_id", "track", "v_int").orderBy("idx")
    notes = notes.withColumns({"_next": F.lead("_abs").over(pitch), "_next_kind": F.lead("token_type").over(pitch)}).where(hit("NOTE_ONSET"))
    told = F.when(F.col("_kind") == "NOTE_DURATION", F.col("_value") + 1)
    duration = F.coalesce(told, F.when(F.col("_next_kind") == "NOTE_OFFSET", F.col("_next") - F.col("_abs")), F.lit(1)).cast("int")
    return notes.select("piece_id", "track", "bar", "time", "velocity", F.col("v_int").alias("pitch"), duration.alias("duration"), "instrument", "track_type")
