"""Token vocabularies of the encoders.

An encoder is a list of domains in token order. A domain has plain values (each its own token) or mapped ones (a token for each mapped value, in order of
first sight). Vocabularies have a few thousand rows at most, so they are made on the driver and joined by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

SCHEMA = "encoder string, token int, token_type string, v_int int, v_str string, v_num int, v_den int, is_canonical boolean"


@dataclass(frozen=True)
class Config:
    """Switches of an encoder."""

    both_in_one: bool = False
    unquantized: bool = False
    interleaved: bool = False
    multi_segment: bool = False
    te: bool = False
    do_multi_fill: bool = False
    do_pretrain_map: bool = False
    force_instrument: bool = False
    mark_instrument: bool = True
    mark_genre: bool = False
    mark_density: bool = False
    mark_drum_density: bool = False
    mark_polyphony_quantile: bool = False
    mark_note_duration_quantile: bool = False
    mark_pitch_limits: bool = False
    mark_time_sigs: bool = False
    mark_num_bars: bool = False
    density_continuous: bool = False
    use_velocity_levels: bool = False
    use_drum_offsets: bool = True
    use_note_duration_encoding: bool = False
    use_absolute_time_encoding: bool = False
    embed_dim: int = 0
    resolution: int = 12
    default_tempo: int = 104
    num_bars: int = 4
    max_tracks: int = 12
    transpose: int = 0


@dataclass(frozen=True)
class Encoder:
    name: str
    domains: tuple[tuple[str, object], ...]
    config: Config = field(default_factory=Config)
    supported: bool = True


def rows_of(domains: tuple[tuple[str, object], ...]) -> list[tuple]:
    """(token, type, v_int, v_str, v_num, v_den, canonical): the last value of a token is the one it decodes to."""
    out: list[list] = []
    base = 0
    for kind, values in domains:
        pairs = [(i, i) for i in range(values)] if isinstance(values, int) else list(values.items()) if isinstance(values, dict) else [(v, v) for v in values]
        local: dict = {}
        last: dict[int, int] = {}
        for value, mapped in pairs:
            token = base + local.setdefault(mapped, len(local))
            last[token] = len(out)
            num, den = value if isinstance(value, tuple) else (None, None)
            out.append([token, kind, value if isinstance(value, int) else None, value if isinstance(value, str) else None, num, den, False])
        for at in last.values():
            out[at][-1] = True
        base += len(local)
    return [tuple(r) for r in out]


def _encoders() -> dict[str, Encoder]:
    one = lambda *names: [(n, 1) for n in names]
    tracks, device = [fixed.STANDARD, fixed.STANDARD_DRUM], list(range(8))
    level = {v: fixed.velocity_level(v) for v in range(128)}
    dense = {p: fixed.instrument_group(p, True) for p in range(128)}
    fill = one("FILL_IN_PLACEHOLDER", "FILL_IN_START", "FILL_IN_END")
    head = lambda n, t=tracks: [("PIECE_START", n), *one("BAR", "BAR_END"), ("TRACK", t), ("TRACK_END", 1)]
    events = [("INSTRUMENT", 128), ("NOTE_OFFSET", 128), ("NOTE_ONSET", 128), ("TIME_DELTA", 48)]
    timed = lambda clock, n, inst=128: [("INSTRUMENT", inst), ("NOTE_ONSET", 128), ("NOTE_DURATION", 96), (clock, n)]
    density, poly, dur = [("DENSITY_LEVEL", 10)], [("MIN_POLYPHONY", 10), ("MAX_POLYPHONY", 10)], [("MIN_NOTE_DURATION", 6), ("MAX_NOTE_DURATION", 6)]
    velocity = [("VELOCITY_LEVEL", level)]
    base = Config(force_instrument=True)
    both = replace(base, both_in_one=True)
    quant = replace(both, mark_note_duration_quantile=True, use_note_duration_encoding=True)
    full = replace(both, use_note_duration_encoding=True, use_absolute_time_encoding=True, mark_time_sigs=True, mark_drum_density=True)
    wide = lambda sizes, sigs, t: [("PIECE_START", 2), ("NUM_BARS", sizes), *one("BAR", "BAR_END"), ("TIME_SIGNATURE", sigs), ("TRACK", t), ("TRACK_END", 1)]
    rich = replace(full, mark_note_duration_quantile=True, mark_polyphony_quantile=True, use_drum_offsets=False, use_velocity_levels=True)
    genre = lambda t: (head(2) + events + fill + density + [("GENRE", fixed.GENRES[t])], replace(both, mark_density=True, mark_genre=True))
    cont = replace(both, mark_time_sigs=True, density_continuous=True, use_drum_offsets=False)
    sig9, times = [("TIME_SIGNATURE", fixed.BASIC)], wide([1, 2, 4, 8], fixed.BASIC, device)
    el = lambda sigs, clock, inst: wide([4, 8], sigs, tracks) + timed("TIME_ABSOLUTE", clock, inst) + fill + dur + poly + density + velocity
    specs = {
        "TE_TRACK_DENSITY_ENCODER": (head(2, device) + events + [("FILL_IN", 3)] + density, replace(both, mark_density=True, use_drum_offsets=False, te=True)),
        "TRACK_DENSITY_ENCODER_V2": (head(2) + events + fill + density, replace(both, mark_density=True, use_drum_offsets=False)),
        "TRACK_INTERLEAVED_ENCODER": ([("PIECE_START", 1), *one("BAR", "BAR_END"), ("INSTRUMENT", 256), *events[1:]], Config(interleaved=True)),
        "TRACK_INTERLEAVED_W_HEADER_ENCODER": ([("PIECE_START", 1), *one("BAR", "BAR_END"), ("INSTRUMENT", 256), *events[1:], ("HEADER", 2)], Config(interleaved=True)),
        "TRACK_ENCODER": (head(1) + events, base),
        "TRACK_NO_INST_ENCODER": (head(1) + events, Config(mark_instrument=False)),
        "TRACK_UNQUANTIZED_ENCODER": ([("PIECE_START", 1)], Config(unquantized=True)),
        "TRACK_DENSITY_ENCODER": (head(1) + events + density, replace(base, mark_density=True)),
        "TRACK_BAR_FILL_DENSITY_ENCODER": (head(1) + events + fill + density, replace(base, mark_density=True, do_multi_fill=True)),
        "TRACK_NOTE_DURATION_CONT_ENCODER": (head(2) + events + fill + sig9, replace(cont, embed_dim=3)),
        "TRACK_NOTE_DURATION_EMBED_ENCODER": (head(2) + events + fill + sig9, replace(cont, embed_dim=1)),
        "DENSITY_GENRE_ENCODER": genre("discogs"),
        "DENSITY_GENRE_TAGTRAUM_ENCODER": genre("tagtraum"),
        "DENSITY_GENRE_LASTFM_ENCODER": genre("lastfm"),
        "POLYPHONY_ENCODER": (head(2) + events + fill + poly, replace(both, mark_polyphony_quantile=True)),
        "POLYPHONY_DURATION_ENCODER": (head(2) + events + fill + poly + dur, replace(both, mark_polyphony_quantile=True, mark_note_duration_quantile=True)),
        "DURATION_ENCODER": (head(2) + events + fill + dur, replace(both, mark_note_duration_quantile=True)),
        "NEW_DURATION_ENCODER": (head(2) + timed("TIME_DELTA", 48) + fill + dur, quant),
        "TE_ENCODER": (times + timed("TIME_ABSOLUTE", 96) + fill + dur + poly + density, replace(full, mark_note_duration_quantile=True, mark_polyphony_quantile=True, te=True)),
        "NEW_VELOCITY_ENCODER": (head(2) + timed("TIME_DELTA", 48) + fill + velocity, replace(both, use_note_duration_encoding=True, use_velocity_levels=True)),
        "ABSOLUTE_ENCODER": (head(2) + timed("TIME_ABSOLUTE", 96) + fill + dur, replace(quant, use_absolute_time_encoding=True)),
        "MULTI_LENGTH_ENCODER": ([("PIECE_START", 2), ("NUM_BARS", [1, 2, 4, 8]), *head(2)[1:]] + timed("TIME_ABSOLUTE", 96) + fill + dur, replace(quant, use_absolute_time_encoding=True)),
        "TE_VELOCITY_DURATION_POLYPHONY_ENCODER": (times + timed("TIME_ABSOLUTE", 96) + fill + dur + poly + density + velocity, replace(rich, te=True)),
        "TE_VELOCITY_ENCODER": (times + timed("TIME_ABSOLUTE", 96) + fill + density + velocity, replace(full, mark_density=True, use_drum_offsets=False, use_velocity_levels=True, te=True)),
        "EL_VELOCITY_DURATION_POLYPHONY_ENCODER": (el(fixed.BLUE, 96, dense), rich),
        "EL_VELOCITY_DURATION_POLYPHONY_YELLOW_ENCODER": (el(fixed.YELLOW, 192, dense), rich),
        "EL_VELOCITY_DURATION_POLYPHONY_YELLOW_FIXED_ENCODER": (el(fixed.YELLOW, 192, 128), replace(rich, do_pretrain_map=True)),
        "ENCODER_VT": (
            wide([4, 8], fixed.BLUE, tracks) + timed("TIME_ABSOLUTE", 192) + fill + [(f"{n}_HARD", v) for n, v in dur + poly] + [("REST_PERCENTAGE", 10), *density, ("PITCH_CLASS", 12), *velocity],
            replace(rich, do_pretrain_map=True),
        ),
    }
    out = {n: Encoder(n, tuple(d), c) for n, (d, c) in specs.items()}
    # continuous domains have no tokens, so this one cannot be built
    out["TRACK_NOTE_DURATION_ENCODER"] = Encoder("TRACK_NOTE_DURATION_ENCODER", (), Config(), supported=False)
    return out


ENCODERS = _encoders()


def get_encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name!r}")
    if not ENCODERS[name].supported:
        raise NotImplementedError(f"{name} needs continuous domains")
    return ENCODERS[name]


def encoder_size(name: str) -> int:
    return max(r[0] for r in rows_of(get_encoder(name).domains)) + 1


def vocabulary(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """All (encoder, token, value) rows; a token's canonical row is the value that it decodes to."""
    names = [n for n, e in ENCODERS.items() if e.supported] if names is None else names
    return spark.createDataFrame([(n, *r) for n in names for r in rows_of(get_encoder(n).domains)], SCHEMA)


def token_of(name: str, kind: str, value: Column, missing: str = "null") -> Column:
    """Token of a plain value as an expression: offset plus place; null (or an error) outside the domain."""
    rows = [r for r in rows_of(get_encoder(name).domains) if r[1] == kind and r[2] is not None]
    if not rows:
        return F.lit(None).cast("int")
    m = F.create_map(*[F.lit(x) for r in rows for x in (r[2], r[0])])
    found = F.try_element_at(m, value.cast("int"))
    return found if missing == "null" else F.coalesce(found, F.raise_error(F.concat(F.lit(f"{kind} has no value "), value.cast("string"))).cast("int"))


def token_mask(name: str, wanted: dict[str, list[int]]) -> list[int]:
    """0/1 over the vocabulary: the given values of each type, -1 for all of them."""
    rows = rows_of(get_encoder(name).domains)
    on = {r[0] for r in rows if r[1] in wanted and (wanted[r[1]] == [-1] or r[2] in wanted[r[1]])}
    return [int(t in on) for t in range(encoder_size(name))]


def encode_values(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """rows (encoder, token_type, v_int, v_str, v_num, v_den, ...) with their token; null for values outside the domain."""
    keys = ["encoder", "token_type", "v_int", "v_str", "v_num", "v_den"]
    v = vocab.select(*[F.col(k).alias(f"_{k}") for k in keys], "token")
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return rows.join(F.broadcast(v), on, "left").drop(*[f"_{k}" for k in keys])


def decode_tokens(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """rows (encoder, token, ...) with type and value."""
    return rows.join(F.broadcast(vocab.where("is_canonical").drop("is_canonical")), ["encoder", "token"], "left")


def token_types(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, types): which token types occur, sorted."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("token_type")).alias("types"))
