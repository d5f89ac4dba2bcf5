"""Row-local expressions: quantisation, levels, track types, token text and bit packing. All are built-in columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def lookup(values: dict, key: Column) -> Column:
    """A small constant map as an expression."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def quantize_beat(x: Column, tpq: Column, spq: Column, cut: float = 0.5) -> Column:
    """Tick snapped to the grid of spq steps a quarter."""
    return F.floor(F.floor(x / tpq * spq + (1 - cut)) * (tpq / spq)).cast("int")


def quantize_second(x: Column, ticks: Column, spq: Column, steps_per_second: Column) -> Column:
    return F.floor(x / ticks * spq * steps_per_second + 0.5).cast("int")


def quantize_step(x: Column, tpq: Column, spq: Column) -> Column:
    """Number of the nearest step, ties up."""
    return F.floor(x / tpq * spq + 0.5).cast("int")


def relative_step(tick: Column, bar_start: Column, tpq: Column, spq: Column) -> Column:
    """Step from the bar's start, ties away from zero."""
    return F.round((tick - bar_start) / tpq * spq).cast("int")


def bar_ticks(tpq: Column, num: Column, den: Column) -> Column:
    return F.floor(4 * tpq * num / den).cast("int")


def beat_length(num: Column, den: Column) -> Column:
    """Quarters in a bar."""
    return (num / den * 4).cast("float")


def beat_length_truncated(ticks: Column, tpq: Column) -> Column:
    """Whole quarters in a bar, for results that must match the parse rule with integer division."""
    return F.floor(ticks / tpq).cast("int")


def track_type_of_voice(channel: Column) -> Column:
    return F.when(channel == 9, fixed.STANDARD_DRUM).otherwise(fixed.STANDARD)


def opz_track_type(channel: Column, instrument: Column, pitch: Column) -> Column:
    return F.when(channel == 9, lookup({p: fixed.opz_drum_type(p) for p in range(128)}, pitch)).otherwise(lookup({p: fixed.opz_instrument_type(p) for p in range(128)}, instrument))


def duration_level(d: Column) -> Column:
    """0..5 by powers of two of three steps."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.log2(F.greatest(d / 3, F.lit(1e-6))) + 1))).cast("int")


def clip(n: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(n, high))


def polyphony_bin(q: Column) -> Column:
    return F.greatest(F.least(q, F.lit(10)), F.lit(1)) - 1


def density_bin(average: Column, quantiles: Column) -> Column:
    """Smallest bin whose quantile is not below the average."""
    return F.size(F.filter(quantiles, lambda q: q < average))


def density_target(quantiles: Column, bin_: Column) -> Column:
    return F.element_at(quantiles, bin_ + 1)


def is_drum_track(track_type: Column) -> Column:
    return track_type.isin(*fixed.DRUM_TYPES)


def is_opz_track(track_type: Column) -> Column:
    return track_type <= 7


def gm_key(is_drum: Column, instrument: Column) -> Column:
    """Place of a program among 256: drums follow the melodic ones."""
    return is_drum.cast("int") * 128 + instrument


def flatten_velocity(velocity: Column, v: int) -> Column:
    return F.when(velocity > 0, v).otherwise(velocity)


def transpose(pitch: Column, is_drum: Column, by: Column) -> Column:
    return pitch + F.when(~is_drum, by).otherwise(0)


def velocity_level(v: Column) -> Column:
    return F.floor(F.floor(v / F.lit(128 / 31)) + (v > 0).cast("int")).cast("int")


def instrument_group(i: Column, dense: bool) -> Column:
    return lookup({p: fixed.instrument_group(p, dense) for p in range(128)}, i)


def integer_beat_length(num: Column, den: Column) -> Column:
    return F.round(num / den * 1000).cast("int")


def rest_token(rest: Column, domain: int) -> Column:
    return F.round(rest * (domain - 1)).cast("int")


def bits_to_words(pitches: Column) -> Column:
    """Pitches of one step as two 64-bit words."""
    word = lambda w: F.aggregate(F.filter(pitches, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))
    return F.array(word(0), word(1))


def words_to_bits(words: Column) -> Column:
    """128 truth values of two words."""
    return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.getbit(F.element_at(words, F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")) == 1)


def transpose_words(words: Column, by: int) -> Column:
    """Shift of the 128 pitches; those that leave the range are lost."""
    left, right = (lambda c, n: F.call_function("shiftleft", c, F.lit(n))), (lambda c, n: F.call_function("shiftrightunsigned", c, F.lit(n)))
    low, high, n, zero = words[0], words[1], abs(by), F.lit(0).cast("long")
    if n == 0:
        return words
    if n >= 128:
        return F.array(zero, zero)
    if by > 0:
        return F.array(zero, left(low, n - 64)) if n >= 64 else F.array(left(low, n), left(high, n).bitwiseOR(right(low, 64 - n)))
    return F.array(right(high, n - 64), zero) if n >= 64 else F.array(right(low, n).bitwiseOR(left(high, 64 - n)), right(high, n))


def selection_kind(selected: Column) -> Column:
    """CONDITION, RESAMPLE or INFILL, by how many bars are selected."""
    n = count_selected(selected)
    return F.when(n == 0, "CONDITION").when(n == F.size(selected), "RESAMPLE").otherwise("INFILL")


def count_selected(selected: Column) -> Column:
    return F.size(F.filter(selected, lambda x: x))


def pretty(token_type: Column, v_int: Column, v_str: Column, v_num: Column, v_den: Column) -> Column:
    return F.concat(token_type, F.lit(" = "), F.coalesce(v_str, F.when(v_num.isNotNull(), F.concat_ws("/", v_num, v_den)), v_int.cast("string")))


def note_off(status: Column, p2: Column) -> Column:
    """0x8n, or 0x9n of velocity 0."""
    kind = status.bitwiseAND(240)
    return (kind == 128) | ((kind == 144) & (p2 == 0))


def note_on(status: Column, p2: Column) -> Column:
    return (status.bitwiseAND(240) == 144) & (p2 > 0)


def message_kind(status: Column, p1: Column, p2: Column, meta_type: Column) -> Column:
    """Name of a message's kind; predicates compare with it."""
    kind = status.bitwiseAND(240)
    meta = {0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyric", 0x06: "marker", 0x07: "cue", 0x2F: "end_of_track", 0x51: "tempo", 0x58: "time_signature", 0x59: "key_signature"}
    pedal = {64: "sustain", 67: "soft"}
    controller = F.when(p1.isin(*pedal), F.concat(lookup(pedal, p1), F.when(p2 >= 64, "_on").otherwise("_off"))).otherwise("controller")
    return (
        F.when(status == 255, F.coalesce(lookup(meta, meta_type), F.lit("meta"))).when(note_off(status, p2), "note_off").when(kind == 144, "note_on").when(kind == 160, "aftertouch")
        .when(kind == 176, controller).when(kind == 192, "patch_change").when(kind == 208, "pressure").when(kind == 224, "pitch_bend").otherwise("system")
    )


def tempo_bpm(micros: Column) -> Column:
    return F.lit(6e7) / micros


def seconds_per_tick(micros: Column, tpq: Column) -> Column:
    return micros / 1e6 / tpq
