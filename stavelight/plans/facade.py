"""One call from files, JSON or tokens to each other. Each step is a composition of the package's tables; the tables of a piece are cut off by reliable checkpoints.

A piece is a dict of tables: pieces, tracks (piece_id, track, instrument, track_type), bars (piece_id, bar, ts_num, ts_den), events (piece_id, track, pitch, tick,
velocity, seq, bar, bar_start, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as A
from ..operators import notes as N
from ..operators import segments as G
from ..session import checkpointed
from ..sources import dataset, smf
from . import encode as E
from . import vocab

KEY = ["piece_id", "track"]


def held(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, cut off in the shared folder: encoders read each several times, and plans stay small."""
    return {k: checkpointed(v) for k, v in t.items()}


def midi_to_piece(files: DataFrame, resolution: int = 12, te: bool = False, name: str = "path", content: str = "content") -> dict[str, DataFrame]:
    """Tables of files (name, content); bad files are in ``errors`` (piece_id, error)."""
    messages = checkpointed(smf.decode(files, name, content))
    t = smf.pieces(messages, resolution, te, checkpointed)
    return t | {"events": checkpointed(t["events"]), "errors": messages.where("error is not null").select("piece_id", "error")}


def with_features(t: dict[str, DataFrame], quantiles: DataFrame | None = None, genre: str = "NONE") -> dict[str, DataFrame]:
    """t with what encoders mark of tracks, and with note durations. quantiles (instrument, quantiles): density deciles; without them the density bin is 0."""
    drum = S.is_drum_track(F.col("track_type"))
    ev = t["events"].join(t["tracks"].select(*KEY, drum.alias("_drum")), KEY)
    on = N.note_durations(ev, F.col("_drum"))
    events = on.unionByName(ev.where("velocity = 0 and not _drum").withColumn("duration", F.lit(0)), allowMissingColumns=True).withColumn("duration", F.col("duration").cast("int")).drop("_drum")
    notes = on.where("duration > 0").select(*KEY, "pitch", F.col("tick").alias("start"), (F.col("tick") + F.col("duration")).alias("end"))
    lengths = notes.groupBy(*KEY).agg(F.max("end").cast("int").alias("max_tick"))
    f = A.track_features(notes, lengths)
    f = f.select(
        *KEY, F.col("min_polyphony_q_bin").alias("min_polyphony"), F.col("max_polyphony_q_bin").alias("max_polyphony"), F.col("min_duration_q").alias("min_note_duration"), F.col("max_duration_q").alias("max_note_duration"),
        "min_polyphony_hard", "max_polyphony_hard", F.col("min_duration_hard").alias("min_note_duration_hard"), F.col("max_duration_hard").alias("max_note_duration_hard"), "rest_percentage",
    )
    tracks = t["tracks"].join(f, KEY, "left").join(A.pitch_classes(events), KEY, "left")
    tracks = tracks.withColumn("pitch_classes", F.coalesce("pitch_classes", F.array_repeat(F.lit(False), 12))).fillna(0).withColumn("genre", F.lit(genre))
    if quantiles is None:
        tracks = tracks.withColumn("density_bin", F.lit(0))
    else:
        density = A.density_bins(A.note_density(events).join(t["tracks"].select(*KEY, "instrument"), KEY), quantiles, ["instrument"])
        tracks = tracks.join(density.select(*KEY, F.col("bin").alias("density_bin")), KEY, "left").fillna(0, ["density_bin"])
    return t | held({"tracks": tracks, "events": events})


def piece_to_tokens(t: dict[str, DataFrame], encoder: str, quantiles: DataFrame | None = None, genre: str = "NONE", fills: DataFrame | None = None, num_bars: bool = True, preprocess: bool = True) -> DataFrame:
    """(piece_id, idx, token_type, value, token, problem). preprocess: compute the tracks' features; else they are columns of tracks already, and durations of events."""
    e = vocab.get_encoder(encoder)
    t = with_features(t, quantiles, genre) if preprocess else t
    if e.config.interleaved:
        return E.encode_interleaved(encoder, t["tracks"], t["bars"].select("piece_id", "bar").distinct(), t["events"])
    bars = t["bars"].select("piece_id", "bar", "ts_num", "ts_den").distinct()
    return E.encode(encoder, t["tracks"], bars, t["events"], fills, num_bars)


def piece_to_json(t: dict[str, DataFrame], resolution: int = 12, tempo: int = 120) -> DataFrame:
    """(piece_id, json)."""
    order = Window.partitionBy(*KEY, "bar").orderBy("time", F.least("velocity", F.lit(1)), "pitch", "seq")
    events = t["events"].where("bar is not null").withColumn("pos", F.row_number().over(order) - 1)
    own = t["bars"].select("piece_id", "bar", "ts_num", "ts_den").distinct().join(t["tracks"].select(*KEY), "piece_id")
    return dataset.to_pieces(t["tracks"].select(*KEY, "instrument", "track_type"), own, events, resolution, tempo)


def json_to_piece(rows: DataFrame, column: str = "json", resolution: int = 12) -> dict[str, DataFrame]:
    """Tables of rows (piece_id, json); ticks run on from bar to bar."""
    parsed = dataset.parse_pieces(rows, column)
    t = parsed.select("piece_id", F.posexplode("piece.tracks").alias("track", "t"))
    tracks = t.select("piece_id", "track", F.coalesce("t.instrument", F.lit(0)).alias("instrument"), F.coalesce(F.col("t.trackType").try_cast("int"), F.lit(10)).alias("track_type"))
    every = dataset.piece_bars(parsed)
    bars = every.groupBy("piece_id", "bar").agg(F.min_by("ts_num", "track").alias("ts_num"), F.min_by("ts_den", "track").alias("ts_den"))
    length = F.floor(F.col("ts_num") / F.col("ts_den") * 4 * resolution).cast("int")
    start = F.sum(length).over(Window.partitionBy("piece_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1))
    bars = bars.withColumn("bar_start", F.coalesce(start, F.lit(0)))
    events = dataset.piece_events(parsed).join(bars.select("piece_id", "bar", "bar_start"), ["piece_id", "bar"])
    seq = F.row_number().over(Window.partitionBy("piece_id", "track").orderBy("bar", "pos")) - 1
    events = events.select("piece_id", "track", "pitch", (F.col("bar_start") + F.col("time")).cast("int").alias("tick"), "velocity", seq.alias("seq"), "bar", "bar_start", "time")
    pieces = parsed.select("piece_id", F.coalesce("piece.resolution", F.lit(resolution)).alias("resolution"), F.coalesce("piece.tempo", F.lit(120)).alias("tempo"), F.when(F.col("piece").isNull(), "no JSON").alias("problem"))
    return held({"pieces": pieces, "tracks": tracks, "bars": bars, "events": events})


def tokens_to_piece(sequences: DataFrame, encoder: str, resolution: int = 12) -> dict[str, DataFrame]:
    """Tables of sequences (piece_id, tokens)."""
    session = sequences.sparkSession
    rows = sequences.select("piece_id", F.posexplode("tokens").alias("idx", "token")).withColumn("encoder", F.lit(encoder))
    d = vocab.decode_tokens(rows, vocab.vocabulary(session, [encoder]))
    w = Window.partitionBy("piece_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda k: F.col("token_type") == k
    d = d.withColumn("track", F.sum(hit("TRACK").cast("int")).over(w) - 1)
    in_track = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("bar", F.sum(hit("BAR").cast("int")).over(in_track) - 1)
    tracks = d.where("track >= 0").groupBy(*KEY).agg(F.first(F.when(hit("TRACK"), F.col("v_int")), True).alias("track_type"), F.coalesce(F.first(F.when(hit("INSTRUMENT"), F.col("v_int")), True), F.lit(0)).alias("instrument"))
    own = d.where("bar >= 0").groupBy(*KEY, "bar").agg(F.first(F.when(hit("TIME_SIGNATURE"), F.struct("v_num", "v_den")), True).alias("s"))
    bars = own.groupBy("piece_id", "bar").agg(F.min_by("s", "track").alias("s")).select("piece_id", "bar", F.coalesce("s.v_num", F.lit(4)).alias("ts_num"), F.coalesce("s.v_den", F.lit(4)).alias("ts_den"))
    length = F.floor(F.col("ts_num") / F.col("ts_den") * 4 * resolution).cast("int")
    bars = bars.withColumn("bar_start", F.coalesce(F.sum(length).over(Window.partitionBy("piece_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    notes = E.decode(d.drop("track", "bar"), resolution).drop("instrument", "track_type").join(bars.select("piece_id", "bar", "bar_start"), ["piece_id", "bar"])
    notes = notes.withColumn("on", (F.col("bar_start") + F.col("time")).cast("int"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("on", "pitch")) * 2
    ends = F.array(F.struct(F.col("on").alias("tick"), F.col("velocity").alias("velocity"), F.col("seq").alias("seq")), F.struct((F.col("on") + F.col("duration")).alias("tick"), F.lit(0).alias("velocity"), (F.col("seq") + 1).alias("seq")))
    events = notes.withColumn("seq", number).select(*KEY, "pitch", F.explode(ends).alias("e")).select(*KEY, "pitch", "e.*")
    grid = bars.select("piece_id", "bar", F.col("bar_start").alias("start_tick"))
    from ..operators.bars import events_to_bars

    placed = events_to_bars(events, grid).withColumn("time", F.col("tick") - F.col("bar_start"))
    return held({"pieces": tracks.select("piece_id").distinct().withColumn("resolution", F.lit(resolution)), "tracks": tracks, "bars": bars, "events": placed})


def piece_to_midi(t: dict[str, DataFrame], resolution: int = 12, tempo: int = 120) -> DataFrame:
    """(piece_id, content). Signatures are told where they change."""
    w = Window.partitionBy("piece_id").orderBy("bar")
    at = "bar_start" if "bar_start" in t["bars"].columns else "start_tick"
    sig = t["bars"].select("piece_id", "bar", F.col(at).alias("tick"), "ts_num", "ts_den").distinct()
    sig = sig.withColumn("_same", F.lag(F.struct("ts_num", "ts_den")).over(w).eqNullSafe(F.struct("ts_num", "ts_den"))).where("not _same").select("piece_id", "tick", "ts_num", "ts_den")
    return smf.to_bytes(t["tracks"], t["events"].select(*KEY, "tick", "velocity", "pitch"), tempo, resolution, sig)


def midi_to_json(files: DataFrame, resolution: int = 12, te: bool = False) -> DataFrame:
    return piece_to_json(midi_to_piece(files, resolution, te), resolution)


def midi_to_tokens(files: DataFrame, encoder: str, **more) -> DataFrame:
    """(piece_id, tokens)."""
    c = vocab.get_encoder(encoder).config
    return E.sequences(piece_to_tokens(midi_to_piece(files, c.resolution, c.te), encoder, **more))


def json_to_tokens(rows: DataFrame, encoder: str, **more) -> DataFrame:
    return E.sequences(piece_to_tokens(json_to_piece(rows, resolution=vocab.get_encoder(encoder).config.resolution), encoder, **more))


def json_to_midi(rows: DataFrame, resolution: int = 12) -> DataFrame:
    return piece_to_midi(json_to_piece(rows, resolution=resolution), resolution)


def json_track_to_midi(rows: DataFrame, track: int, resolution: int = 12) -> DataFrame:
    """Files of one track of each piece."""
    t = json_to_piece(rows, resolution=resolution)
    return piece_to_midi(t | {k: t[k].where(F.col("track") == track) for k in ("tracks", "events")}, resolution)


def tokens_to_json(sequences: DataFrame, encoder: str) -> DataFrame:
    r = vocab.get_encoder(encoder).config.resolution
    return piece_to_json(tokens_to_piece(sequences, encoder, r), r)


def tokens_to_midi(sequences: DataFrame, encoder: str) -> DataFrame:
    r = vocab.get_encoder(encoder).config.resolution
    return piece_to_midi(tokens_to_piece(sequences, encoder, r), r)


def json_bytes(t: dict[str, DataFrame], seglen: int, min_tracks: int, genre: str = "NONE", resolution: int = 12) -> DataFrame:
    """(piece_id, content): JSON with valid segments and genre as bytes; empty where a piece has no valid segment."""
    grid = t["bars"].select("piece_id", "bar").distinct().join(t["tracks"].select(*KEY), "piece_id")
    valid = G.valid_segments(A.has_notes(t["events"], grid), seglen, min_tracks)
    own = valid.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("start", "tracks"))).alias("segments"))
    tail = F.concat(F.lit(',"validSegments":'), F.to_json("segments"), F.lit(f',"genre":"{genre}"}}'))
    df = piece_to_json(t, resolution).join(own, "piece_id", "left")
    content = F.when(F.col("segments").isNull(), F.lit("")).otherwise(F.concat(F.expr("left(json, length(json) - 1)"), tail))
    return df.select("piece_id", F.encode(content, "UTF-8").alias("content"))


def convert_feature(dim: int, polyphony: Column, silence: Column, duration: Column, duration_norm: Column) -> Column:
    """Embedding of a bar: polyphony, silence and duration, or the normalised duration alone; zeros where the bar has no features."""
    value = F.array(*[c.cast("double") for c in ((polyphony, silence, duration) if dim == 3 else (duration_norm,))])
    return F.when(polyphony.isNull(), empty_embedding(dim)).otherwise(F.transform(value, lambda x: F.coalesce(x, F.lit(0.0))))


def empty_embedding(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def encode_with_embeddings(t: dict[str, DataFrame], encoder: str, bar_features: DataFrame, **more) -> DataFrame:
    """Token rows with ``embedding``: that of its track's bar on each BAR token, zeros elsewhere. bar_features: as features.bar_features gives them."""
    dim = vocab.get_encoder(encoder).config.embed_dim
    tokens = piece_to_tokens(t, encoder, **more)
    w = Window.partitionBy("piece_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    place = F.dense_rank().over(Window.partitionBy("piece_id").orderBy("track")) - 1
    ids = t["tracks"].select("piece_id", "track", place.alias("_t"))
    df = tokens.withColumn("_t", F.sum((F.col("token_type") == "TRACK").cast("int")).over(w) - 1)
    in_track = Window.partitionBy("piece_id", "_t").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("bar", F.when(F.col("token_type") == "BAR", F.sum((F.col("token_type") == "BAR").cast("int")).over(in_track) - 1))
    df = df.join(ids, ["piece_id", "_t"], "left").join(bar_features, ["piece_id", "track", "bar"], "left")
    own = convert_feature(dim, *[F.col(c) for c in ("av_polyphony", "silence", "note_duration", "note_duration_norm")])
    return df.select("piece_id", "idx", "token_type", "value", "token", own.alias("embedding"), "problem")
