"""Per-track and per-bar features: polyphony, duration, density, pitch content, onset grids.

Notes: piece_id, track, pitch, start, end (absolute steps). Active counts are a line sweep over the ends of notes, so they cost two rows a note, however long
it is; steps are counted out only where a result lists them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ["piece_id", "track"]


def nearest_rank(values: Column, q: float) -> Column:
    """Order statistic at min(round(n q), n - 1), 0 for no values. values: a sorted array."""
    n = F.size(values)
    return F.when(n == 0, 0).otherwise(F.element_at(values, F.least(F.round(n * F.lit(q)), n - 1).cast("int") + 1))


def active_runs(notes: DataFrame, keys: list[str] = KEY, last: Column | None = None) -> DataFrame:
    """(keys, step, length, active): runs of steps over which the same notes sound, where any do, and how many those are. last: steps from here on don't count."""
    end = F.col("end") if last is None else F.least("end", last)
    ends = F.array(F.struct(F.col("start").alias("step"), F.lit(1).alias("_d")), F.struct(end.alias("step"), F.lit(-1).alias("_d")))
    df = notes.where(F.col("start") < end).select(*keys, F.inline(ends))
    w = Window.partitionBy(*keys).orderBy("step")
    # of rows at one step only the last has a length
    df = df.withColumns({"active": F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"), "length": F.lead("step").over(w) - F.col("step")})
    return df.where("length > 0 and active > 0").select(*keys, "step", "length", "active")


def active_steps(notes: DataFrame, keys: list[str] = KEY, last: Column | None = None) -> DataFrame:
    """(keys, step, active): how many notes sound at each step with any. last: steps from here on don't count."""
    return active_runs(notes, keys, last).select(*keys, F.explode(F.sequence("step", F.col("step") + F.col("length") - 1)).alias("step"), "active")


def max_polyphony(notes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return active_runs(notes, keys).groupBy(*keys).agg(F.max("active").alias("max_polyphony"))


def polyphony(notes: DataFrame, lengths: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, av_polyphony, silence, min_q, max_q, min, max) with lengths (keys, max_tick), of tracks of any length. The last step is never counted.

    min_q and max_q are the order statistics at .15 and .85 of the non-zero counts.
    """
    runs = active_runs(notes.join(lengths, keys), keys, F.col("max_tick") - 1)
    # a count and how many steps have it stand for the steps
    counts = runs.groupBy(*keys, "active").agg(F.sum("length").alias("_f"))
    sums = counts.groupBy(*keys).agg(F.sum(F.col("active") * F.col("_f")).alias("_sum"), F.sum("_f").alias("_n"), F.min("active").alias("min_polyphony"), F.max("active").alias("max_polyphony"), F.sort_array(F.collect_list(F.struct("active", "_f"))).alias("_all"))
    full = lengths.join(sums, keys, "left")
    n, length = F.coalesce("_n", F.lit(0)), F.col("max_tick")

    def rank(q: float) -> Column:
        """Order statistic at min(round(n q), n - 1) of the counts, 0 for none."""
        place = F.least(F.round(n * F.lit(q)), n - 1)
        found = F.aggregate(
            "_all", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("of")),
            lambda a, x: F.struct((a["seen"] + x["_f"]).alias("seen"), F.coalesce(a["of"], F.when(a["seen"] + x["_f"] > place, x["active"])).alias("of")), lambda a: a["of"],
        )
        return F.coalesce(found, F.lit(0))

    return full.select(
        *keys, (F.coalesce("_sum", F.lit(0)) / F.greatest(n, F.lit(1))).alias("av_polyphony"), ((length - n) / F.greatest(length, F.lit(1))).alias("silence"),
        rank(0.15).alias("min_polyphony_q"), rank(0.85).alias("max_polyphony_q"), F.coalesce("min_polyphony", F.lit(0)).alias("min_polyphony"), F.coalesce("max_polyphony", F.lit(0)).alias("max_polyphony"),
    )


def polyphony_distribution(notes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(piece_id, track, polyphony_distribution): how many notes sound at each step with any, in order of steps; the last step is never counted."""
    runs = active_runs(notes.join(lengths, KEY), KEY, F.col("max_tick") - 1)
    told = F.transform(F.array_sort(F.collect_list(F.struct("step", "active", "length"))), lambda x: F.array_repeat(x["active"], x["length"]))
    return runs.groupBy(*KEY).agg(F.flatten(told).alias("polyphony_distribution"))


def durations(notes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, note_duration, level bounds): mean length, and the order statistics and extremes of the duration levels."""
    length = F.col("end") - F.col("start")
    level = S.duration_level(length)
    # six levels, so six counts a group stand for its sorted levels
    sums = [F.sum((level == i).cast("int")).alias(f"_{i}") for i in range(6)]
    df = notes.groupBy(*keys).agg(F.avg(length).alias("note_duration"), F.min(level).alias("min_duration_hard"), F.max(level).alias("max_duration_hard"), F.count(F.lit(1)).alias("_n"), *sums)

    def rank(q: float) -> Column:
        place, seen, out = F.least(F.round(F.col("_n") * F.lit(q)), F.col("_n") - 1), F.lit(0), F.lit(5)
        for i in range(6):
            seen = seen + F.col(f"_{i}")
            out = F.when(place < seen, i) if i == 0 else out.when(place < seen, i)
        return out.otherwise(5).cast("int")

    return df.select(*keys, "note_duration", rank(0.15).alias("min_duration_q"), rank(0.85).alias("max_duration_q"), "min_duration_hard", "max_duration_hard")


def track_features(notes: DataFrame, lengths: DataFrame) -> DataFrame:
    """All of a track's polyphony and duration features, with the bins that tokens use."""
    both = polyphony(notes, lengths).join(durations(notes), KEY, "left")
    for c in ("min_polyphony_q", "max_polyphony_q"):
        both = both.withColumn(f"{c}_bin", S.polyphony_bin(F.col(c)))
    both = both.withColumns({"min_polyphony_hard": S.polyphony_bin(F.col("min_polyphony")), "max_polyphony_hard": S.polyphony_bin(F.col("max_polyphony")), "rest_percentage": F.col("silence")})
    return both.fillna(0)


def bar_features(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """(piece_id, track, bar, av_polyphony, silence, note_duration, note_duration_norm); bars has max_tick; notes are relative to their bar."""
    keys = [*KEY, "bar"]
    df = polyphony(notes, bars.select(*keys, "max_tick"), keys).join(notes.groupBy(*keys).agg(F.avg(F.col("end") - F.col("start")).alias("note_duration")), keys, "left").join(bars.select(*keys, "max_tick"), keys)
    mean = F.coalesce("note_duration", F.lit(0.0))
    return df.select(*keys, "av_polyphony", "silence", mean.alias("note_duration"), (mean / F.greatest("max_tick", F.lit(1))).alias("note_duration_norm"))


def bar_density(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Onsets of every bar, empty ones included."""
    keys = [*KEY, "bar"]
    n = events.where("velocity > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return bars.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def note_density(events: DataFrame) -> DataFrame:
    """(piece_id, track, onsets, bars, density): onsets a non-empty bar."""
    df = events.where("velocity > 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("onsets"), F.count_distinct("bar").alias("bars"))
    return df.withColumn("density", F.col("onsets") / F.greatest("bars", F.lit(1)))


def density_bins(density: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """density with its bin from quantiles (keys, quantiles array); a missing row gives bin 0."""
    df = density.join(quantiles, keys, "left")
    return df.withColumn("bin", F.when(F.col("quantiles").isNull(), 0).otherwise(S.density_bin(F.round("density"), F.col("quantiles")))).drop("quantiles")


def deciles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quantiles): the nine deciles, interpolated and truncated, and 2**30 last, of counts (keys, n, f): a number n that occurs f times.

    Rows are one a number and group. A decile lies between the numbers of two ranks, which running sums of f find, so nothing is sorted but the
    numbers, and all arithmetic is in integers.
    """
    by = Window.partitionBy(*keys)
    df = counts.groupBy(*keys, "n").agg(F.sum("f").alias("f"))
    df = df.withColumns({"_to": F.sum("f").over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("f").over(by)})
    last = F.col("_all") - 1
    rank = lambda i: F.floor(last * i / 10)
    ends = [F.min(F.when(F.col("_to") > F.least(rank(i) + k, last), F.col("n"))).alias(f"_{i}_{k}") for i in range(1, 10) for k in (0, 1)]
    df = df.groupBy(*keys).agg(F.first("_all").alias("_all"), *ends)
    part = lambda i: (F.col("_all") - 1) * i % 10
    between = [F.floor((F.col(f"_{i}_0") * (10 - part(i)) + F.col(f"_{i}_1") * part(i)) / 10).cast("int") for i in range(1, 10)]
    return df.select(*keys, F.array(*between, F.lit(1 << 30)).alias("quantiles"))


def corpus_density_quantiles(bar_counts: DataFrame, keys: list[str], drums_as: Column | None = None) -> DataFrame:
    """(keys, quantiles): deciles of onsets in non-empty bars. bar_counts: keys, n."""
    df = bar_counts.where("n > 0")
    df = df.withColumn(keys[-1], drums_as) if drums_as is not None else df
    return deciles(df.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("f")), keys)


#: The device's drum types, which share one distribution; the program that stands for all drums.
DEVICE_DRUMS, DRUM_PROGRAM = (0, 1, 2), 128


def density_tables(bar_counts: DataFrame) -> DataFrame:
    """(track_type, program, quantiles, first_equal): both density tables of a corpus in one aggregate of bar_counts (track_type, instrument, n; drum types by S.is_drum_track).

    Rows with a null track_type are by program, all drums being program 128; others are the device's, by type and program: its drum types share one distribution, which
    stands for each program. Bars without onsets don't count; nor do, in the device's table, tracks of other types.
    """
    own = F.col("track_type").isin(*DEVICE_DRUMS)
    rows = bar_counts.where("n > 0").select(
        F.when(own, F.lit(-1)).when(S.is_opz_track(F.col("track_type")), F.col("track_type")).cast("int").alias("kind"), F.when(own, 0).otherwise(F.col("instrument")).cast("int").alias("of"),
        F.when(S.is_drum_track(F.col("track_type")), DRUM_PROGRAM).otherwise(F.col("instrument")).cast("int").alias("program"), F.col("n").cast("long").alias("n"),
    )
    sets = rows.groupingSets([["program", "n"], ["kind", "of", "n"]], "kind", "of", "program", "n").agg(F.count(F.lit(1)).alias("f"), F.grouping("program").alias("device"))
    table = deciles(sets.where("device = 0 or kind is not null"), ["device", "kind", "of", "program"])
    kinds = F.when(F.col("device") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") < 0, F.array(*map(F.lit, DEVICE_DRUMS))).otherwise(F.array("kind"))
    programs = F.when(F.col("device") == 0, F.array("program")).when(F.col("kind") < 0, F.sequence(F.lit(0), F.lit(127))).otherwise(F.array("of"))
    out = table.select("quantiles", programs.alias("programs"), F.explode(kinds).alias("track_type")).select("track_type", F.explode("programs").alias("program"), "quantiles")
    return out.withColumn("first_equal", first_equal(F.col("quantiles")))


def first_equal(quantiles: Column) -> Column:
    """Each quantile's first place among equal ones."""
    return F.transform(quantiles, lambda q: (F.array_position(quantiles, q) - 1).cast("int"))


def has_notes(events: DataFrame, bars: DataFrame) -> DataFrame:
    keys = [*KEY, "bar"]
    own = events.groupBy(*keys).agg(F.bool_or(F.col("velocity") > 0).alias("has_notes"))
    return bars.join(own, keys, "left").withColumn("has_notes", F.coalesce("has_notes", F.lit(False)))


def pitch_range(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Lowest and highest onset of each track; 2147483647 and 0 for none."""
    own = events.where("velocity > 0").groupBy(*KEY).agg(F.min("pitch").alias("min_pitch"), F.max("pitch").alias("max_pitch"))
    df = tracks.join(own, KEY, "left")
    return df.withColumns({"min_pitch": F.coalesce("min_pitch", F.lit(2147483647)), "max_pitch": F.coalesce("max_pitch", F.lit(0))})


def pitch_classes(events: DataFrame) -> DataFrame:
    """Which of the twelve classes have onsets."""
    own = events.where("velocity > 0").groupBy(*KEY).agg(F.collect_set(F.col("pitch") % 12).alias("_s"))
    return own.select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.array_contains("_s", i)).alias("pitch_classes"))


def pitch_extents(events: DataFrame, drum: Column) -> DataFrame:
    """Lowest and highest pitch of a piece over onsets and offsets, without drums."""
    return events.where(~drum).groupBy("piece_id").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"))


def onset_distribution(events: DataFrame, size: int) -> DataFrame:
    """(piece_id, counts): onsets by time modulo size."""
    n = events.where("velocity > 0").groupBy("piece_id", (F.col("tick") % size).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("piece_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("piece_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0).cast("long"))).alias("counts"))


GRIDS = (4, 12, 8, 24, 16, 48, 32, 96)


def quantize_info(events: DataFrame, resolution: int) -> DataFrame:
    """Share of a piece's onsets on each of eight grids; every onset is on a grid finer than the resolution."""
    on = lambda g: F.avg(F.when(F.lit(resolution // g == 0) | (F.col("tick") % max(resolution // g, 1) == 0), 1.0).otherwise(0.0))
    return events.where("velocity > 0").groupBy("piece_id").agg(*[on(g).alias(f"grid_{g}") for g in GRIDS])


def control_errors(wanted: DataFrame, got: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute difference of each column over the tracks of both."""
    df = wanted.join(got.select(*KEY, *[F.col(c).alias(f"_{c}") for c in columns]), KEY)
    return df.agg(*[F.avg(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns])
