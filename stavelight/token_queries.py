"""Encoders against SQL: token rows of whole pieces in event mode, with velocities, densities, polyphony, time signatures, infilling and interleaving.

The SQL is written from the token layouts that ``expected`` has typed in and from what each encoder says about a piece, a level a union; nothing of it comes from the encoders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import expected
from .functions import fixed
from .plans import encode as E
from .queries import DERIVED, ORACLES, bar_notes, events, query, track_table

BARS = 64
#: What heads tell of a track, by token kind: a value in SQL over t (track, drum, piece_id). The same numbers as ``_inputs`` gives.
HEAD = {
    "INSTRUMENT": "piece_id * 7 % 128", "DENSITY_LEVEL": "track % 10", "GENRE": "14", "MIN_POLYPHONY": "track % 3", "MAX_POLYPHONY": "track % 3 + 4", "MIN_NOTE_DURATION": "track % 2", "MAX_NOTE_DURATION": "track % 2 + 3",
    "MIN_POLYPHONY_HARD": "track % 4", "MAX_POLYPHONY_HARD": "track % 4 + 5", "MIN_NOTE_DURATION_HARD": "1", "MAX_NOTE_DURATION_HARD": "5", "REST_PERCENTAGE": "round(track / 8::DOUBLE * 9)::INT",
}


def _inputs(spark, sf_dir, device: bool = False, offsets: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, bars and events of pieces of 64 bars from line items. device: track types 1 to 7 of the device; offsets: with note-offs in the onset's bar."""
    n = bar_notes(spark, sf_dir)
    t = F.col("track")
    tracks = n.select("piece_id", "track").distinct().withColumns({
        "track_type": t if device else F.when(t == 7, fixed.STANDARD_DRUM).otherwise(fixed.STANDARD), "instrument": (F.col("piece_id") * 7 % 128).cast("int"), "density_bin": t % 10, "genre": F.lit("rock"),
        "min_polyphony": t % 3, "max_polyphony": t % 3 + 4, "min_note_duration": t % 2, "max_note_duration": t % 2 + 3, "min_polyphony_hard": t % 4, "max_polyphony_hard": t % 4 + 5, "min_note_duration_hard": F.lit(1),
        "max_note_duration_hard": F.lit(5), "rest_percentage": t / 8, "pitch_classes": F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (i + t) % 3 == 0),
    })
    bars = n.select("piece_id").distinct().select("piece_id", F.explode(F.sequence(F.lit(0), F.lit(BARS - 1))).alias("bar")).withColumns({"ts_num": F.lit(4), "ts_den": F.lit(4)})
    ev = n.withColumn("velocity", (F.col("seq") % 127 + 1).cast("int"))
    if offsets:
        off = ev.withColumns({"time": F.least(F.col("time") + F.col("duration"), F.lit(48)), "velocity": F.lit(0), "seq": F.col("seq") + F.lit(1 << 40)})
        ev = ev.unionByName(off)
    return tracks, bars, ev


def _sql(encoder: str, heads: list[str], drums: str = "track = 7", kind: str = "CASE WHEN track = 7 THEN 1 ELSE 0 END", density: str = "true", rest: str = "true", event_mode: bool = False, drum_ends: bool = True, absolute: bool = False, velocity: bool = False, signatures: bool = False, pitch_classes: bool = False, fills: bool = False, started: int = 0) -> str:
    """Token rows of an encoder. heads: kinds in order; density, rest: which tracks tell their density, and the kinds from polyphony on."""
    at, i = {}, 0
    for k, size in expected.DOMAINS[encoder]:
        at[k], i = i, i + size
    row = lambda a, b, c, d, e, f, g, token, source: f"SELECT piece_id, {a} AS a, {b} AS b, {c} AS c, {d} AS d, {e} AS e, {f} AS f, {g} AS g, {token} AS token FROM {source}"
    late = [k for k in heads if k.startswith(("MIN", "MAX", "REST"))]
    value = dict(HEAD)
    if encoder in ("EL_VELOCITY_DURATION_POLYPHONY_YELLOW_FIXED_ENCODER", "ENCODER_VT"):
        value["INSTRUMENT"] = f"CASE WHEN drum THEN piece_id * 7 % 128 ELSE {expected.GROUP_PROGRAMS}[piece_id * 7 % 128 + 1] END"
    rows = [row(0, 0, 0, 0, 0, 0, 0, at["PIECE_START"] + started, "p"), row(1, "track", 0, -1, 0, 0, 0, f"{at['TRACK']} + {kind}", "t"), row(1, "track", 2, 0, 0, 0, 0, at["TRACK_END"], "t")]
    for n, k in enumerate(heads):
        if k == "PITCH_CLASS":
            rows.append(row(1, "track", 0, n, "x", 0, 0, f"{at[k]} + x", "t, (SELECT unnest(range(0, 12)) AS x) WHERE NOT drum AND (x + track) % 3 = 0"))
        else:
            told = density if k == "DENSITY_LEVEL" else rest if k in late else "true"
            rows.append(row(1, "track", 0, n, 0, 0, 0, f"{at[k]} + {value[k]}", f"t WHERE {told}"))
    rows += [row(1, "track", 1, "bar", 0, 0, 0, at["BAR"], "b"), row(1, "track", 1, "bar", 9, 0, 0, at["BAR_END"], "b")]
    if signatures:
        rows.append(row(1, "track", 1, "bar", 1, 0, 0, at["TIME_SIGNATURE"], "b"))
    if fills:
        rows += [row(1, "track", 1, "bar", 2, 0, 0, at["FILL_IN_PLACEHOLDER"], "z"), row(2, "track", "bar", 0, 0, 0, 0, at["FILL_IN_START"], "z"), row(2, "track", "bar", 2, 0, 0, 0, at["FILL_IN_END"], "z")]
    place = ("CASE WHEN hole THEN 2 ELSE 1 END", "track", "CASE WHEN hole THEN bar ELSE 1 END", "CASE WHEN hole THEN 1 ELSE bar END", "CASE WHEN hole THEN 0 ELSE 3 END", "i") if fills else (1, "track", 1, "bar", 3, "i")
    put = lambda j, token, where: row(*place, j, token, f"g WHERE {where}")
    clock = f"{at['TIME_ABSOLUTE']} + time" if absolute else f"{at['TIME_DELTA']} + gap - 1"
    rows.append(put(0, clock, "gap > 0"))
    if velocity:
        rows.append(put(1, f"{at['VELOCITY_LEVEL']} + level", "level > 0 AND level IS DISTINCT FROM before"))
    rows.append(put(2, f"{at['NOTE_ONSET']} + pitch", "up = 1"))
    if event_mode:
        rows.append(put(2, f"{at['NOTE_OFFSET']} + pitch", "up = 0"))
    else:
        rows.append(put(3, f"{at['NOTE_DURATION']} + least(duration, 96) - 1", "true" if drum_ends else "NOT drum"))
    ends = f" UNION ALL SELECT piece_id, track, bar, least(time + duration, 48), pitch, duration, seq + 1099511627776, 0, 0 FROM bn WHERE {'true' if drum_ends else f'NOT ({drums})'}" if event_mode else ""
    some = "" if event_mode else " WHERE duration > 0"
    return f""", t AS (SELECT DISTINCT piece_id, track, {drums} AS drum FROM bn), p AS (SELECT DISTINCT piece_id FROM bn), b AS (SELECT piece_id, track, unnest(range(0, {BARS})) AS bar FROM t), z AS (SELECT DISTINCT piece_id, track, bar FROM bn WHERE bar % 9 = 0),
x AS (SELECT piece_id, track, bar, time, pitch, duration, seq, 1 AS up, floor(floor((seq % 127 + 1) / (128 / 31.0)) + 1)::INT AS level FROM bn{some}{ends}),
g AS (SELECT *, {drums} AS drum, bar % 9 = 0 AS hole, time - coalesce(lag(time) OVER w, 0) AS gap, lag(level) OVER w AS before, row_number() OVER w AS i FROM x WINDOW w AS (PARTITION BY piece_id, track, bar ORDER BY time, up, pitch, seq)),
r AS ({' UNION ALL '.join(rows)})
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY a, b, c, d, e, f, g) - 1)::INT AS idx, token::INT AS token FROM r"""


def _tokens(encoder: str, inputs, fills: DataFrame | None = None) -> DataFrame:
    return E.encode(encoder, *inputs, fills, num_bars=False)


def _plain(df: DataFrame) -> DataFrame:
    return df.select("piece_id", "idx", "token")


@query(_sql("TRACK_ENCODER", ["INSTRUMENT"], event_mode=True))
def encoded_events(spark, sf_dir):
    """Onsets and offsets, drums' too."""
    return _plain(_tokens("TRACK_ENCODER", _inputs(spark, sf_dir, offsets=True)))


@query(_sql("TRACK_DENSITY_ENCODER_V2", ["INSTRUMENT", "DENSITY_LEVEL"], event_mode=True, drum_ends=False))
def encoded_density(spark, sf_dir):
    """Drums without offsets; densities."""
    return _plain(_tokens("TRACK_DENSITY_ENCODER_V2", _inputs(spark, sf_dir, offsets=True)))


@query(_sql("DENSITY_GENRE_ENCODER", ["GENRE", "INSTRUMENT", "DENSITY_LEVEL"], event_mode=True))
def encoded_genre(spark, sf_dir):
    return _plain(_tokens("DENSITY_GENRE_ENCODER", _inputs(spark, sf_dir, offsets=True)))


@query(_sql("POLYPHONY_DURATION_ENCODER", ["INSTRUMENT", "MIN_POLYPHONY", "MAX_POLYPHONY", "MIN_NOTE_DURATION", "MAX_NOTE_DURATION"], event_mode=True))
def encoded_polyphony(spark, sf_dir):
    return _plain(_tokens("POLYPHONY_DURATION_ENCODER", _inputs(spark, sf_dir, offsets=True)))


@query(_sql("NEW_VELOCITY_ENCODER", ["INSTRUMENT"], velocity=True))
def encoded_velocities(spark, sf_dir):
    return _plain(_tokens("NEW_VELOCITY_ENCODER", _inputs(spark, sf_dir)))


_DEVICE = {"drums": "track <= 2", "kind": "track", "absolute": True, "signatures": True}


@query(_sql("TE_VELOCITY_DURATION_POLYPHONY_ENCODER", ["INSTRUMENT", "DENSITY_LEVEL", "MIN_POLYPHONY", "MAX_POLYPHONY", "MIN_NOTE_DURATION", "MAX_NOTE_DURATION"], density="drum", rest="NOT drum", drum_ends=False, velocity=True, **_DEVICE))
def encoded_device(spark, sf_dir):
    """The device's track types; drums tell their density, the others their polyphony and durations."""
    return _plain(_tokens("TE_VELOCITY_DURATION_POLYPHONY_ENCODER", _inputs(spark, sf_dir, device=True)))


_RICH = {"density": "drum", "rest": "NOT drum", "drum_ends": False, "velocity": True, "absolute": True, "signatures": True}


@query(_sql("EL_VELOCITY_DURATION_POLYPHONY_YELLOW_FIXED_ENCODER", ["INSTRUMENT", "DENSITY_LEVEL", "MIN_POLYPHONY", "MAX_POLYPHONY", "MIN_NOTE_DURATION", "MAX_NOTE_DURATION"], **_RICH))
def encoded_grouped_programs(spark, sf_dir):
    """Melodic programs by their group."""
    return _plain(_tokens("EL_VELOCITY_DURATION_POLYPHONY_YELLOW_FIXED_ENCODER", _inputs(spark, sf_dir)))


@query(_sql("ENCODER_VT", ["INSTRUMENT", "PITCH_CLASS", "DENSITY_LEVEL", "MIN_POLYPHONY_HARD", "MAX_POLYPHONY_HARD", "MIN_NOTE_DURATION_HARD", "MAX_NOTE_DURATION_HARD", "REST_PERCENTAGE"], pitch_classes=True, **_RICH))
def encoded_hard_limits(spark, sf_dir):
    """Pitch classes, hard limits and rests."""
    return _plain(_tokens("ENCODER_VT", _inputs(spark, sf_dir)))


_QUANTILES = ["INSTRUMENT", "MIN_NOTE_DURATION", "MAX_NOTE_DURATION"]


def _holes(ev: DataFrame) -> DataFrame:
    return ev.select("piece_id", "track", "bar").distinct().where("bar % 9 = 0")


@query(_sql("ABSOLUTE_ENCODER", _QUANTILES, absolute=True, fills=True, started=1))
def encoded_infill(spark, sf_dir):
    """Every ninth bar that has notes is left out and told at the end."""
    inputs = _inputs(spark, sf_dir)
    return _plain(_tokens("ABSOLUTE_ENCODER", inputs, _holes(inputs[2])))


@query(_sql("ABSOLUTE_ENCODER", _QUANTILES, absolute=True, started=1))
def resolved_infill(spark, sf_dir):
    """What is told at the end put back into its bars."""
    inputs = _inputs(spark, sf_dir)
    return _plain(E.resolve_fills(_tokens("ABSOLUTE_ENCODER", inputs, _holes(inputs[2]))))


def _interleaved(header: bool) -> str:
    place = {"PIECE_START": 0, "BAR": 1, "BAR_END": 2, "INSTRUMENT": 3, "NOTE_OFFSET": 259, "NOTE_ONSET": 387, "TIME_DELTA": 515, "HEADER": 563}  # sums of the layout's sizes
    head = f" UNION ALL SELECT piece_id, 0, 1, 0, 0, 0, {place['HEADER']} FROM p UNION ALL SELECT piece_id, 0, 2, inst, 0, 0, {place['INSTRUMENT']} + inst FROM (SELECT DISTINCT piece_id, inst FROM s) UNION ALL SELECT piece_id, 0, 3, 0, 0, 0, {place['HEADER']} + 1 FROM p" if header else ""
    return f""", s AS (SELECT ev.*, instrument + CASE WHEN track_type = 11 THEN 128 ELSE 0 END AS inst FROM ev JOIN tr USING (piece_id, track)), p AS (SELECT DISTINCT piece_id FROM ev), b AS (SELECT DISTINCT piece_id, bar FROM ev),
g AS (SELECT *, time - coalesce(lag(time) OVER (PARTITION BY piece_id, bar ORDER BY time, onoff, inst, pitch, seq), 0) AS gap, lag(inst) OVER w AS before, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY piece_id ORDER BY bar, time, onoff, inst, pitch, seq)),
r AS (SELECT piece_id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, {place['PIECE_START']} AS token FROM p UNION ALL SELECT piece_id, 1, bar, 0, 0, 0, {place['BAR']} FROM b UNION ALL SELECT piece_id, 1, bar, 2, 0, 0, {place['BAR_END']} FROM b
UNION ALL SELECT piece_id, 1, bar, 1, i, 0, {place['TIME_DELTA']} + gap - 1 FROM g WHERE gap > 0 UNION ALL SELECT piece_id, 1, bar, 1, i, 1, {place['INSTRUMENT']} + inst FROM g WHERE inst IS DISTINCT FROM before
UNION ALL SELECT piece_id, 1, bar, 1, i, 2, CASE WHEN onoff = 1 THEN {place['NOTE_ONSET']} ELSE {place['NOTE_OFFSET']} END + pitch FROM g{head})
SELECT piece_id, (row_number() OVER (PARTITION BY piece_id ORDER BY a, b, c, d, e) - 1)::INT AS idx, token::INT AS token FROM r"""


def _mixed(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return E.encode_interleaved("TRACK_INTERLEAVED_W_HEADER_ENCODER", track_table(spark, sf_dir), e.select("piece_id", "bar").distinct(), e)


@query(_interleaved(True))
def encoded_interleaved(spark, sf_dir):
    """All tracks in one stream, the instruments of a piece first."""
    return _plain(_mixed(spark, sf_dir))


@query(_interleaved(False))
def stripped_header(spark, sf_dir):
    """The same without the instruments that stand between the header's tokens."""
    return _plain(E.strip_header(_mixed(spark, sf_dir)))


def _kinds(encoder: str, sql: str, columns: str) -> str:
    """Numbers of tokens by piece and kind, from SQL of token rows: kinds are ranges of the layout."""
    at, rows = 0, []
    for kind, size in expected.DOMAINS[encoder]:
        rows.append(f"('{kind}', {at}, {at + size})")
        at += size
    head, tail = sql.rsplit("\nSELECT", 1)
    return f"{head}, tk AS (SELECT{tail}), kd AS (SELECT * FROM (VALUES {', '.join(rows)}) v(token_type, lo, hi)) SELECT piece_id, token_type, count(*)::BIGINT AS n{columns} FROM tk JOIN kd ON token >= lo AND token < hi GROUP BY piece_id, token_type"


# queries that count tokens by kind
ORACLES["encoded_absolute_infill"] = DERIVED + _kinds("ABSOLUTE_ENCODER", _sql("ABSOLUTE_ENCODER", _QUANTILES, absolute=True, fills=True, started=1), ", 0::BIGINT AS problems")
ORACLES["interleaved_tokens"] = DERIVED + _kinds("TRACK_INTERLEAVED_W_HEADER_ENCODER", _interleaved(True), "")
