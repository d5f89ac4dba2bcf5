"""Time: bar grids, as-of joins of events to bars, patches and tempos, delta ticks.

As-of joins are unions ordered in one window by piece: linear, unlike a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def bar_grid(signatures: DataFrame, ends: DataFrame) -> DataFrame:
    """(piece_id, bar, start_tick, ticks, ts_num, ts_den, beat_length).

    signatures: piece_id, tick, ts_num, ts_den; the last of equal ticks counts, 4/4 at 0 where none starts there; bars of no length go. ends: piece_id,
    max_tick, tpq. Bars run from each signature to the next or to max_tick; a bar that the next signature cuts short stays, shortened.
    """
    base = ends.select("piece_id", F.lit(0).alias("tick"), F.lit(4).alias("ts_num"), F.lit(4).alias("ts_den"), F.lit(0).alias("_given"))
    every = signatures.select("piece_id", "tick", "ts_num", "ts_den", F.lit(1).alias("_given")).unionByName(base)
    best = Window.partitionBy("piece_id", "tick").orderBy(F.desc("_given"), F.desc("ts_num"), F.desc("ts_den"))
    df = every.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(ends, "piece_id").where("tick < max_tick")
    df = df.withColumn("ticks", S.bar_ticks(F.col("tpq"), F.col("ts_num"), F.col("ts_den"))).where("ticks > 0")
    following = F.coalesce(F.lead("tick").over(Window.partitionBy("piece_id").orderBy("tick")), F.col("max_tick"))
    df = df.withColumn("_next", following).withColumn("start_tick", F.explode(F.sequence("tick", F.col("_next") - 1, F.col("ticks"))))
    number = F.row_number().over(Window.partitionBy("piece_id").orderBy("start_tick")) - 1
    length = F.least(F.col("ticks"), F.col("_next") - F.col("start_tick"))
    return df.select("piece_id", number.alias("bar"), "start_tick", length.alias("ticks"), "ts_num", "ts_den", S.beat_length(F.col("ts_num"), F.col("ts_den")).alias("beat_length"))


def as_of(rows: DataFrame, states: DataFrame, keys: list[str], order: str, columns: list[str], before: Column | None = None) -> DataFrame:
    """rows with the columns of the last state at or before them by order; before: rows for which the state must lie strictly before."""
    strict = F.lit(False) if before is None else before
    marked = rows.withColumns({"_rank": F.when(strict, 0).otherwise(2), **{f"_{c}": F.lit(None).cast(states.schema[c].dataType) for c in columns}})
    other = states.select(*keys, order, F.lit(1).alias("_rank"), *[F.col(c).alias(f"_{c}") for c in columns])
    w = Window.partitionBy(*keys).orderBy(order, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(other, allowMissingColumns=True)
    filled = both.withColumns({c: F.last(F.col(f"_{c}"), ignorenulls=True).over(w) for c in columns})
    return filled.where("_rank <> 1").drop("_rank", *[f"_{c}" for c in columns])


def events_to_bars(events: DataFrame, grid: DataFrame) -> DataFrame:
    """Events with bar and bar_start; an offset on a bar line belongs to the bar before. Events before the first bar have nulls."""
    bars = grid.select("piece_id", F.col("start_tick").alias("tick"), "bar", F.col("start_tick").alias("bar_start"))
    return as_of(events, bars, ["piece_id"], "tick", ["bar", "bar_start"], F.col("velocity") == 0)


def carry_patches(messages: DataFrame) -> DataFrame:
    """Channel messages with the program in force: the last patch change of the channel in the track, 0 before any."""
    w = Window.partitionBy("piece_id", "smf_track", "channel").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    patch = F.when(F.col("status").bitwiseAND(240) == 192, F.col("p1"))
    return messages.withColumn("instrument", F.coalesce(F.last(patch, ignorenulls=True).over(w), F.lit(0)))


def tempo_map(tempos: DataFrame, files: DataFrame) -> DataFrame:
    """(piece_id, tick, seconds, per_tick): piecewise linear time; 120 beats a minute before any tempo. tempos: piece_id, tick, micros; files: piece_id, tpq."""
    base = files.select("piece_id", F.lit(0).alias("tick"), F.lit(500_000).alias("micros"), F.lit(0).alias("_given"))
    every = tempos.select("piece_id", "tick", "micros", F.lit(1).alias("_given")).unionByName(base)
    df = every.withColumn("_r", F.row_number().over(Window.partitionBy("piece_id", "tick").orderBy(F.desc("_given"), F.desc("micros")))).where("_r = 1").join(files, "piece_id")
    df = df.withColumn("per_tick", S.seconds_per_tick(F.col("micros"), F.col("tpq")))
    w = Window.partitionBy("piece_id").orderBy("tick")
    step = (F.col("tick") - F.lag("tick").over(w)) * F.lag("per_tick").over(w)
    df = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return df.select("piece_id", "tick", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seconds"), "per_tick")


def with_seconds(rows: DataFrame, tempo: DataFrame) -> DataFrame:
    """rows with the seconds of their tick."""
    t = tempo.select("piece_id", "tick", F.col("tick").alias("_at"), F.col("seconds").alias("_base"), F.col("per_tick").alias("_rate"))
    df = as_of(rows, t, ["piece_id"], "tick", ["_at", "_base", "_rate"])
    return df.withColumn("seconds", F.col("_base") + (F.col("tick") - F.col("_at")) * F.col("_rate")).drop("_at", "_base", "_rate")


def tick_at_second(rows: DataFrame, tempo: DataFrame) -> DataFrame:
    """The inverse: rows (piece_id, seconds) with their tick."""
    t = tempo.select("piece_id", "seconds", F.col("tick").alias("_at"), F.col("seconds").alias("_base"), F.col("per_tick").alias("_rate"))
    df = as_of(rows, t, ["piece_id"], "seconds", ["_at", "_base", "_rate"])
    return df.withColumn("tick", F.col("_at") + (F.col("seconds") - F.col("_base")) / F.col("_rate")).drop("_at", "_base", "_rate")


def bar_starts(bars: DataFrame, resolution: int) -> DataFrame:
    """Bars with their start in steps: whole steps of each bar add up."""
    w = Window.partitionBy("piece_id").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn("bar_start", F.coalesce(F.sum(F.floor(F.col("beat_length") * resolution)).over(w), F.lit(0)).cast("int"))


def delta_ticks(events: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("tick", "seq")
    return events.withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0)))


def absolute_ticks(events: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("tick", F.sum("delta").over(w))


def adjacent(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows paired with the next one: its columns are prefixed by next_."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
