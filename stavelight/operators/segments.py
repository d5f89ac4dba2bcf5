"""Valid segments and seeded random choices. Randomness is a hash of keys, a seed and a draw number, so reruns and retried tasks agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["piece_id", "track"]


def draw(seed: int, *keys: Column) -> Column:
    """A random text that any engine can make again: the MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def unit(seed: int, *keys: Column) -> Column:
    """Uniform on [0, 1): the first 52 bits of a draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def pick(n: Column, seed: int, *keys: Column) -> Column:
    """Uniform integer on [0, n)."""
    return F.floor(unit(seed, *keys) * n).cast("int")


def pick_element(xs: Column, seed: int, *keys: Column) -> Column:
    return F.when(F.size(xs) > 0, F.element_at(xs, pick(F.size(xs), seed, *keys) + 1))


def shuffled(xs: Column, seed: int, *keys: Column) -> Column:
    order = F.array_sort(F.transform(xs, lambda x, i: F.struct(draw(seed, *keys, i).alias("r"), i.alias("i"), x.alias("x"))))
    return F.transform(order, lambda y: y["x"])


def random_subset(xs: Column, seed: int, *keys: Column) -> Column:
    """Between one and all elements."""
    return F.slice(shuffled(xs, seed, *keys), 1, pick(F.size(xs), seed + 1, *keys) + 1)


def window_counts(bars: DataFrame, seglen: int) -> DataFrame:
    """(piece_id, track, start, filled): bars with notes among the seglen from each start; has_notes by bar. One sliding frame."""
    w = Window.partitionBy(*KEY).orderBy("bar")
    df = bars.withColumns({"filled": F.sum(F.col("has_notes").cast("int")).over(w.rowsBetween(0, seglen - 1)), "_n": F.max("bar").over(Window.partitionBy("piece_id")) + 1})
    return df.where(F.col("bar") <= F.col("_n") - seglen).select(*KEY, F.col("bar").alias("start"), "filled")


def valid_segments(bars: DataFrame, seglen: int, min_tracks: int) -> DataFrame:
    """(piece_id, start, tracks): starts with enough tracks that have notes in three quarters of the bars."""
    need = int(0.75 * seglen + 0.5)
    df = window_counts(bars, seglen).where(F.col("filled") >= need).groupBy("piece_id", "start").agg(F.sort_array(F.collect_list("track")).alias("tracks"))
    return df.where(F.size("tracks") >= min_tracks)


def valid_segments_opz(bars: DataFrame, types: DataFrame, seglen: int, min_tracks: int, arp: int = 6, lead: int = 5, chord: int = 7) -> DataFrame:
    """The rule of the eight-track device: distinct sets of train types count; types: piece_id, track, train_types."""
    need = int(0.75 * seglen + 0.5)
    df = window_counts(bars, seglen).where(F.col("filled") >= need).join(types, KEY)
    kind = F.array_sort("train_types")
    df = df.groupBy("piece_id", "start").agg(F.sort_array(F.collect_list("track")).alias("tracks"), F.collect_set(kind).alias("kinds"), F.collect_list(kind).alias("all_kinds"))
    flexible = F.size(F.filter("all_kinds", lambda k: (k == F.array(F.lit(lead), F.lit(arp))) | (k == F.array(F.lit(lead), F.lit(arp), F.lit(chord)))))
    return df.where((F.size("kinds") >= min_tracks) | (flexible >= 2)).select("piece_id", "start", "tracks")


def select_segments(segments: DataFrame, seed: int, max_tracks: int) -> DataFrame:
    """(piece_id, start, tracks): one segment of each piece, at most max_tracks of its tracks in random order."""
    w = Window.partitionBy("piece_id").orderBy(draw(seed, F.col("piece_id"), F.col("start")), "start")
    one = segments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.withColumn("tracks", F.slice(shuffled(F.col("tracks"), seed, F.col("piece_id")), 1, max_tracks))


#: Fixed value: track types below this are the device's own.
DEVICE_TYPES = 8


def select_segments_opz(segments: DataFrame, types: DataFrame, seed: int, min_tracks: int) -> DataFrame:
    """(piece_id, start, tracks, problem): one segment of each piece and, of its tracks in random order, those that find a type, [{track, track_type}].

    A track takes the first of its train types, in random order, that is the device's and that no track before it has taken; a track without one is left out, so
    there is at most one of each type. Pieces without a segment, and those that are left with fewer than min_tracks, have a problem and no tracks.
    types: piece_id, track, train_types.
    """
    piece, track = F.col("piece_id"), F.col("track")
    one = segments.groupBy("piece_id").agg(F.min_by(F.struct("start", "tracks"), F.struct(draw(seed, piece, F.col("start")), "start")).alias("s")).select("piece_id", "s.*")
    options = F.array_sort(F.transform("train_types", lambda t: F.struct(draw(seed + 1, piece, track, t).alias("r"), t.alias("t"))))
    own = F.filter(F.transform(options, lambda x: x["t"].cast("int")), lambda t: (t >= 0) & (t < DEVICE_TYPES))
    rows = one.select("piece_id", "start", F.explode("tracks").alias("track")).join(types, KEY)
    order = rows.groupBy("piece_id", "start").agg(F.array_sort(F.collect_list(F.struct(draw(seed, piece, track).alias("r"), track.cast("int").alias("track"), own.alias("types")))).alias("order"))
    none = F.array().cast("array<struct<track:int,track_type:int>>")

    def take(taken: Column, x: Column) -> Column:
        free = F.get(F.filter(x["types"], lambda t: ~F.exists(taken, lambda y: y["track_type"] == t)), 0)
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(x["track"].alias("track"), free.alias("track_type")))))

    chosen = order.withColumn("tracks", F.aggregate("order", none, take)).drop("order")
    every = types.select("piece_id").distinct().join(chosen, "piece_id", "left")
    problem = F.when(F.col("start").isNull(), "no valid segments").when(F.size("tracks") < min_tracks, "less than min tracks")
    return every.select("piece_id", "start", F.when(problem.isNull(), F.col("tracks")).alias("tracks"), problem.alias("problem"))


def select_transpose(extents: DataFrame, seed: int) -> DataFrame:
    """A transposition in [-6, 5] that keeps low..high within 0..127."""
    ok = F.filter(F.sequence(F.lit(-6), F.lit(5)), lambda t: (F.col("low") + t >= 0) & (F.col("high") + t <= 127))
    return extents.withColumn("transpose", F.coalesce(pick_element(ok, seed, F.col("piece_id")), F.lit(0)))


def bar_mask(bars: DataFrame, proportion: float, seed: int) -> DataFrame:
    """Bars to fill: a random number, below the proportion, of random bars of each piece."""
    whole = Window.partitionBy("piece_id")
    n = F.count(F.lit(1)).over(whole)
    r = F.row_number().over(whole.orderBy(draw(seed, *[F.col(c) for c in ("piece_id", "track", "bar")]), "track", "bar"))
    return bars.withColumns({"_n": n, "_r": r}).where(F.col("_r") <= pick(F.greatest(F.round(F.col("_n") * proportion), F.lit(1)), seed + 1, F.col("piece_id"))).drop("_n", "_r")


def perturb(notes: DataFrame, share: float, seed: int, bar_steps: int = 48, selected: DataFrame | None = None) -> DataFrame:
    """Notes with new random pitches for some, and problem: "not enough notes" on all notes of a piece that has fewer than are asked for, none of which changes.

    A note can change if it begins and ends in one bar, an end on a bar line belonging to the bar before, and that bar is one of selected (piece_id, track, bar),
    if given. share below 1 is a proportion of those, at least one; else a number.
    """
    bar = F.floor(F.col("start") / bar_steps).cast("int")
    df = notes.withColumns({"_bar": bar, "_can": F.floor((F.col("end") - 1) / bar_steps) == bar})
    if selected is not None:
        own = selected.select(*KEY, F.col("bar").alias("_bar"), F.lit(True).alias("_own")).distinct()
        df = df.join(own, [*KEY, "_bar"], "left").withColumn("_can", F.col("_can") & F.coalesce("_own", F.lit(False))).drop("_own")
    keys = [F.col(c) for c in ("piece_id", "track", "start", "pitch")]
    w = Window.partitionBy("piece_id").orderBy(F.desc("_can"), draw(seed, *keys), "track", "start", "pitch")
    count = F.sum(F.col("_can").cast("int")).over(Window.partitionBy("piece_id"))
    take = F.greatest(F.floor(count * share), F.lit(1)) if share < 1 else F.lit(round(share))
    df = df.withColumns({"_r": F.row_number().over(w), "_take": take, "_of": count})
    hit = F.col("_can") & (F.col("_r") <= F.col("_take")) & (F.col("_of") >= F.col("_take"))
    df = df.withColumns({"pitch": F.when(hit, pick(F.lit(128), seed + 1, *keys)).otherwise(F.col("pitch")), "problem": F.when(F.col("_of") < F.col("_take"), "not enough notes")})
    return df.select(*notes.columns, "problem")


def random_pieces(spark, n: int, tracks: int, bars: int, seed: int, notes_per_bar: int = 6, bar_steps: int = 48) -> DataFrame:
    """Synthetic events (piece_id, track, bar, pitch, tick, velocity, seq): track 0 is drums, notes stay within their bar."""
    base = spark.range(n * tracks * bars * notes_per_bar).select(
        F.floor(F.col("id") / (tracks * bars * notes_per_bar)).alias("piece_id"), (F.floor(F.col("id") / (bars * notes_per_bar)) % tracks).cast("int").alias("track"), (F.floor(F.col("id") / notes_per_bar) % bars).cast("int").alias("bar"), "id",
    )
    on = pick(F.lit(bar_steps - 2), seed, F.col("id"))
    df = base.withColumns({"on": on, "pitch": pick(F.lit(128), seed + 1, F.col("id")), "v": pick(F.lit(119), seed + 2, F.col("id")) + 8}).withColumn("off", F.col("on") + 1 + pick(F.lit(bar_steps - 1) - F.col("on"), seed + 3, F.col("id")))
    ends = F.array(F.struct(F.col("on").alias("t"), F.col("v").alias("v"), (F.col("id") * 2).alias("s")), F.struct(F.col("off").alias("t"), F.lit(0).alias("v"), (F.col("id") * 2 + 1).alias("s")))
    return df.withColumn("e", F.explode(ends)).select("piece_id", "track", "bar", "pitch", (F.col("bar") * bar_steps + F.col("e.t")).alias("tick"), F.col("e.v").alias("velocity"), F.col("e.s").alias("seq"))


def remap_train_types(tracks: DataFrame) -> DataFrame:
    """Train types of device tracks by their largest polyphony: piece_id, track, track_type, max_polyphony."""
    p, t = F.col("max_polyphony"), F.col("track_type")
    flexible = F.array_compact(F.array(F.when(p <= 2, 6), F.when(p <= 3, 5), F.when(p <= 4, 7)))
    own = (
        F.when(t == 9, F.when(F.size(flexible) > 0, flexible).otherwise(F.array(F.lit(9)))).when(t.isin(0, 1, 2) & (p > 2), F.array(F.lit(13)))
        .when((t == 4) & (p > 1), F.array(F.lit(15))).when((t == 3) & (p > 2), F.array(F.lit(14))).otherwise(F.array(t))
    )
    return tracks.withColumn("train_types", own)


def multi_segments(rows: DataFrame, bars: int = 4) -> DataFrame:
    """Rows of whole segments of so many bars, with ``segment``; bars that fill no segment go. rows: piece_id, bar, ..."""
    whole = F.floor((F.max("bar").over(Window.partitionBy("piece_id")) + 1) / bars)
    df = rows.withColumns({"segment": F.floor(F.col("bar") / bars).cast("int"), "_n": whole})
    return df.where("segment < _n").drop("_n").withColumn("bar", F.col("bar") - F.col("segment") * bars)


def status_subset(status: DataFrame, start: int, end: int, tracks: list[int]) -> DataFrame:
    """Requests for bars [start, end) of some tracks, renumbered in the order given."""
    place = F.array_position(F.array(*[F.lit(t) for t in tracks]), F.col("track")).cast("int") - 1
    return status.where(F.col("track").isin(tracks)).withColumns({"selected": F.slice("selected", start + 1, end - start), "track": place})


def status_rehighlight(status: DataFrame, generate: list[tuple[int, int]]) -> DataFrame:
    """Requests that select the given (track, bar) cells only; a track is autoregressive no longer if any of its bars is unselected."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b")) for t, b in generate]) if generate else F.array().cast("array<struct<t:int,b:int>>")
    chosen = F.transform("selected", lambda _, i: F.exists(cells, lambda c: (c["t"] == F.col("track")) & (c["b"] == i)))
    return status.withColumn("selected", chosen).withColumn("autoregressive", F.col("autoregressive") & F.forall("selected", lambda x: x))
