"""Piano rolls and min-hash sketches.

The long form (piece, track, step, pitch) is canonical; words, bytes and arrays are made at the edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, spread

KEY = ["piece_id", "track"]


def roll(notes: DataFrame, bound: int | None = None, keys: list[str] = KEY) -> DataFrame:
    """(keys, step, pitch): cells that a note covers, once each, before step ``bound``.

    A note gives the steps behind those of its pitch that begin before it, so no cell has to be compared with another.
    """
    end = F.col("end") if bound is None else F.least("end", F.lit(bound))
    before = Window.partitionBy(*keys, "pitch").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    df = notes.where(F.col("start") < end).select(*keys, "pitch", "start", end.alias("end"))
    df = df.withColumn("start", F.greatest("start", F.max("end").over(before))).where("start < end")
    return df.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("step"), "pitch")


def bit_roll(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, step, low, high): the 128 pitches of a step as two words."""
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(F.col("pitch") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pitch") % 64).cast("int")))), F.lit(0).cast("long"))
    return cells.groupBy(*keys, "step").agg(word(0).alias("low"), word(1).alias("high"))


def byte_roll(cells: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, step, bytes): sixteen bytes of eight pitches a step."""
    b = lambda i: F.coalesce(F.bit_or(F.when(F.floor(F.col("pitch") / 8) == i, F.call_function("shiftleft", F.lit(1), (F.col("pitch") % 8).cast("int")))), F.lit(0))
    return cells.groupBy(*keys, "step").agg(F.array(*[b(i) for i in range(16)]).alias("bytes"))


def dense_roll(cells: DataFrame, steps: int, keys: list[str] = KEY) -> DataFrame:
    """(keys, roll): steps x 128 of 0 and 1; for the edge only."""
    rows = cells.where(F.col("step") < steps).groupBy(*keys).agg(F.collect_set(F.struct("step", "pitch")).alias("_c"))
    cell = lambda s: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda p: F.array_contains("_c", F.struct(s.cast("int").alias("step"), p.cast("int").alias("pitch"))).cast("int"))
    return rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), cell).alias("roll"))


def bar_roll(notes: DataFrame, bar_steps: int = 48) -> DataFrame:
    """(piece_id, track, bar, step, pitch) with bars of equal length."""
    df = roll(notes).withColumn("bar", F.floor(F.col("step") / bar_steps).cast("int"))
    return df.withColumn("step", (F.col("step") % bar_steps).cast("int"))


#: Fixed values of the public XXH32 algorithm.
_P1, _P2, _P3, _P4, _P5 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
#: Bytes hashed at once.
CHUNK = 1 << 19


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def xxh32_of_windows(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """XXH32 of the k bytes from each position of a byte array, all positions at once."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    byte = data.astype(np.uint32)
    # the four bytes from each position as a little-endian number
    lane = byte[: max(len(byte) - 3, 0)].copy()
    for i in (1, 2, 3):
        lane |= byte[i : i + len(lane)] << np.uint32(8 * i)
    s, at = np.uint32(seed & 0xFFFFFFFF), 0
    with np.errstate(over="ignore"):
        if k >= 16:
            acc = [np.full(n, s + x, np.uint32) for x in (_P1 + _P2, _P2, np.uint32(0), np.uint32(0) - _P1)]
            while at + 16 <= k:
                for i in range(4):
                    acc[i] = _turn(acc[i] + lane[at + 4 * i : at + 4 * i + n] * _P2, 13) * _P1
                at += 16
            h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        else:
            h = np.full(n, s + _P5, np.uint32)
        h += np.uint32(k)
        while at + 4 <= k:
            h = _turn(h + lane[at : at + n] * _P3, 17) * _P4
            at += 4
        while at < k:
            h = _turn(h + byte[at : at + n] * _P5, 11) * _P1
            at += 1
        h = (h ^ (h >> np.uint32(15))) * _P2
        h = (h ^ (h >> np.uint32(13))) * _P3
        return h ^ (h >> np.uint32(16))


def _sketches(column: pa.Array, seeds: list[int], k: int) -> np.ndarray:
    """The least hash by row and seed."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), len(seeds)), np.int64)
    lo = 0
    while lo < len(size):
        hi = lo + 1
        while hi < len(size) and size[lo:hi].sum() + size[hi] <= CHUNK:
            hi += 1
        long = np.flatnonzero(size[lo:hi] >= k) + lo
        for i in np.flatnonzero(size[lo:hi] < k) + lo:
            short = np.frombuffer(column[int(i)].as_py() or b"", np.uint8)
            out[i] = [xxh32_of_windows(short, len(short), s)[0] for s in seeds]
        if len(long):
            data = np.frombuffer(b"".join(column[int(i)].as_py() for i in long), np.uint8)
            first = np.concatenate([[0], np.cumsum(size[long])])
            # windows that leave their row count as the greatest hash
            inside = np.ones(len(data) - k + 1, bool)
            for d in range(1, k):
                inside[(first[1:-1] - d)] = False
            for j, s in enumerate(seeds):
                h = np.where(inside, xxh32_of_windows(data, k, s), np.uint32(0xFFFFFFFF))
                out[long, j] = np.minimum.reduceat(h, first[:-1])
        lo = hi
    return out


def min_hash(rows: DataFrame, column: str, seeds: list[int], k: int, out: str = "sketch") -> DataFrame:
    """rows with, for each seed, the least 32-bit hash of the k-byte shingles of a binary column; bytes shorter than k are one shingle."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            found = _sketches(b.column(b.schema.names.index(column)), seeds, k)
            res = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, max(len(seeds), 1), dtype=np.int32)[: len(found) + 1]), pa.array(found.ravel(), pa.int64())) if seeds else pa.array([[]] * len(found), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, res], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


#: Bars that are laid out as bytes at once.
BARS = 512


def roll_min_hash(cells: DataFrame, seeds: list[int], k: int, bar_steps: int = 48) -> DataFrame:
    """(piece_id, track, bar, sketch) over the sixteen bytes of each step of a bar.

    Cells travel as words of 32 steps of a pitch; tasks lay them out as bytes, some bars at a time.
    """
    keys = [*KEY, "bar"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("step") % 32).cast("int"))
    words = cells.groupBy(*keys, "pitch", F.floor(F.col("step") / 32).cast("int").alias("_c")).agg(F.bit_or(bit).alias("_w"))
    rows = words.groupBy(*keys).agg(F.collect_list(F.struct(F.col("pitch").cast("int").alias("pitch"), "_c", "_w")).alias("_p"))
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BARS):
                b = whole.slice(lo, BARS)
                parts = b.column(len(keys))
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(parts).to_numpy())
                values = parts.flatten()
                pitch, chunk, word = (pc.struct_field(values, c).to_numpy(zero_copy_only=False) for c in ("pitch", "_c", "_w"))
                at, shift = np.nonzero(word[:, None] >> np.arange(32) & 1)
                step = chunk[at] * 32 + shift
                ok = (step >= 0) & (step < bar_steps) & (pitch[at] >= 0) & (pitch[at] < 128)
                grid = np.zeros((b.num_rows, bar_steps, 128), bool)
                grid[row[at][ok], step[ok], pitch[at][ok]] = True
                data = np.packbits(grid, axis=2, bitorder="little").reshape(b.num_rows, -1)
                found = _sketches(pa.array([x.tobytes() for x in data], pa.binary()), seeds, k)
                out = pa.array(found.tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], out], names=[*keys, "sketch"])

    return rows.mapInArrow(run, schema)


#: Steps of a roll from a file at most; longer ones are refused.
ROLL_STEPS = 1000
#: Steps of a stretch of a file in which notes meet bars.
STRETCH = 192


def _file_notes(messages: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    """(notes in steps, (piece_id, tpq, max_tick) of files); a note without an end lasts a step."""
    from ..sources import smf

    good = messages.where("error is null")
    files = good.groupBy("piece_id").agg(F.first("tpq").alias("tpq"), F.max("tick").alias("max_tick"))
    step = lambda c: F.floor(F.col(c) * resolution / F.col("tpq") + 0.5).cast("int")
    n = smf.linked_notes(good).where("velocity > 0")
    notes = n.select("piece_id", F.col("smf_track").alias("track"), F.col("key").alias("pitch"), step("on_tick").alias("start"), F.coalesce(step("off_tick"), step("on_tick") + 1).alias("end"))
    return notes.withColumn("end", F.greatest("end", F.col("start") + 1)), files


def file_bars(messages: DataFrame, resolution: int = 12) -> DataFrame:
    """(piece_id, bar, bar_start, steps) of files, by their time signatures; 4/4 where none is told."""
    from ..sources import smf
    from . import bars as B

    good = messages.where("error is null")
    ends = good.groupBy("piece_id").agg(F.first("tpq").alias("tpq"), (F.max("tick") + 1).cast("int").alias("max_tick"))
    grid = B.bar_grid(smf.signatures(good), ends).join(ends.select("piece_id", "tpq"), "piece_id")
    step = lambda c: F.floor(F.col(c) * resolution / F.col("tpq") + 0.5).cast("int")
    full = F.floor(F.col("beat_length") * resolution + 0.5).cast("int")
    return grid.select("piece_id", "bar", step("start_tick").alias("bar_start"), full.alias("steps"))


def roll_of_file(messages: DataFrame, resolution: int = 12, n_bars: int = 0, start: int = 0) -> DataFrame:
    """(piece_id, step, pitch, problem): cells of a window of n_bars bars of each file, from bar start modulo the places there are; the whole file for 0.

    A file whose window has ``ROLL_STEPS`` steps or more gives one row with a problem instead of cells.
    """
    messages = checkpointed(messages)
    notes, _ = _file_notes(messages, resolution)
    bars = file_bars(messages, resolution)
    total = bars.groupBy("piece_id").agg((F.max("bar") + 1).alias("total"), F.max(F.col("bar_start") + F.col("steps")).alias("all"))
    if n_bars:
        first = total.withColumn("first", F.lit(start) % F.greatest(F.col("total") - n_bars, F.lit(1)))
        own = bars.join(first, "piece_id").where((F.col("bar") >= F.col("first")) & (F.col("bar") < F.col("first") + n_bars))
        window = own.groupBy("piece_id").agg(F.min("bar_start").alias("lo"), F.max(F.col("bar_start") + F.col("steps")).alias("hi"))
    else:
        window = total.select("piece_id", F.lit(0).alias("lo"), F.col("all").alias("hi"))
    rows = notes.join(window.where(F.col("hi") - F.col("lo") < ROLL_STEPS), "piece_id").where("start < hi and end > lo")
    cut = rows.select("piece_id", "pitch", F.explode(F.sequence(F.greatest("start", "lo"), F.least("end", "hi") - 1)).alias("step"), "lo")
    cells = cut.select("piece_id", (F.col("step") - F.col("lo")).alias("step"), "pitch", F.lit(None).cast("string").alias("problem")).distinct()
    return cells.unionByName(window.where(F.col("hi") - F.col("lo") >= ROLL_STEPS).select("piece_id", F.lit(f"{ROLL_STEPS} steps or more").alias("problem")), allowMissingColumns=True)


def bar_roll_of_file(messages: DataFrame, resolution: int = 12) -> DataFrame:
    """(piece_id, track, bar, step, pitch) of each file's own bars, whatever their lengths and number; cells once each.

    A note is cut at the bar lines it crosses: it meets bars in the stretches of the file that both touch, and each pair counts in the first of them.
    """
    messages = checkpointed(messages)
    notes, _ = _file_notes(messages, resolution)
    lines = file_bars(messages, resolution).where("steps > 0").withColumn("bar_end", F.col("bar_start") + F.col("steps"))
    stretch = lambda c: F.floor(F.col(c) / STRETCH).cast("int")
    touched = lambda df, lo, hi: df.withColumn("at", F.explode(F.sequence(stretch(lo), F.floor((F.col(hi) - 1) / STRETCH).cast("int"))))
    # estimates of decoded files are too small to broadcast by
    met = touched(notes, "start", "end").hint("merge").join(touched(lines, "bar_start", "bar_end"), ["piece_id", "at"])
    met = met.where((F.col("bar_start") < F.col("end")) & (F.col("bar_end") > F.col("start")) & (F.col("at") == F.greatest(stretch("start"), stretch("bar_start"))))
    part = met.select(*KEY, "bar", "pitch", F.greatest(F.col("start") - F.col("bar_start"), F.lit(0)).alias("start"), F.least(F.col("end") - F.col("bar_start"), F.col("steps")).alias("end"))
    return roll(spread(part, *KEY, "bar"), keys=[*KEY, "bar"])
