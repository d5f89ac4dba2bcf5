"""Whole-piece operations: prune, reorder, append, slice, pad, merge, validate, compare.

Pieces are rows keyed by (piece_id, track, bar); re-indexing is a filter, a join with a short list, or a row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["piece_id", "track"]


def _listed(df: DataFrame, column: str, values: list[int], new: str) -> DataFrame:
    """Rows whose column is in the list, once for each time it occurs, with its place as ``new``."""
    pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)]) if values else F.array().cast("array<struct<v:int,i:int>>")
    return df.withColumn("_x", F.explode(F.filter(pairs, lambda p: p["v"] == F.col(column)))).withColumn(new, F.col("_x.i")).drop("_x")


def prune_tracks(rows: DataFrame, tracks: list[int], bars: list[int] | None = None) -> DataFrame:
    """Tracks in the given order, repeats kept, unknown ids ignored; bars likewise, none given keeps all. Both are renumbered by place."""
    out = _listed(rows, "track", tracks, "track")
    if bars:
        out = _listed(out, "bar", bars, "bar")
    dense = lambda c: F.dense_rank().over(Window.partitionBy("piece_id").orderBy(c)) - 1
    return out.withColumn("track", dense("track"))


def prune_empty_tracks(rows: DataFrame, bars: list[int]) -> DataFrame:
    """Tracks with an onset in the given bars."""
    own = rows.where((F.col("velocity") > 0) & F.col("bar").isin(*bars)).select(*KEY).distinct()
    return rows.join(own, KEY, "left_semi")


def prune_events(events: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(gone, keys, "left_anti")


def reorder_tracks(rows: DataFrame, order: Column) -> DataFrame:
    """order[i] is the new place of track i."""
    return rows.withColumn("track", F.element_at(order, F.col("track") + 1))


def inverse_order(order: Column) -> Column:
    """argsort of a permutation."""
    return F.transform(F.array_sort(F.transform(order, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda x: x["i"])


def sort_with_instruments(events: DataFrame) -> DataFrame:
    """Order for interleaving: time, offsets first, instrument, pitch."""
    w = Window.partitionBy("piece_id").orderBy("tick", F.least("velocity", F.lit(1)), "instrument", "pitch", "track", "seq")
    return events.withColumn("pos", F.row_number().over(w) - 1)


def unlike_bars(left: DataFrame, right: DataFrame) -> DataFrame:
    """(piece_id, bar, left, right): bars that both pieces have and whose beat lengths differ. Both: piece_id, track, bar, beat_length; a piece's tracks agree."""
    side = lambda df, name: df.groupBy("piece_id", "bar").agg(F.min_by("beat_length", "track").alias(name))
    return side(left, "left").join(side(right, "right"), ["piece_id", "bar"]).where(~F.col("left").eqNullSafe(F.col("right")))


def append_piece(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right's tracks behind left's by piece, cut to left's number of bars; a left piece without tracks takes all. ``unlike_bars`` names pieces that don't fit."""
    size = left.groupBy("piece_id").agg((F.max("track") + 1).alias("_t"), (F.max("bar") + 1).alias("_b"))
    moved = right.join(size, "piece_id", "left").where("_b is null or bar < _b").withColumn("track", F.col("track") + F.coalesce("_t", F.lit(0))).drop("_t", "_b")
    return left.unionByName(moved)


def subset(rows: DataFrame, start: int, end: int, tracks: list[int]) -> DataFrame:
    """Bars [start, end) of some tracks, renumbered."""
    part = rows.where(F.col("bar").between(start, end - 1))
    return _listed(part.withColumn("bar", F.col("bar") - start), "track", tracks, "track")


def pad_with_status(bars: DataFrame, status: DataFrame, least_bars: int) -> DataFrame:
    """bars with all bars that status (piece_id, track, n_bars) names; new ones have beat length 4."""
    want = status.select("piece_id", "track", F.explode(F.sequence(F.lit(0), F.greatest("n_bars", F.lit(least_bars)) - 1)).alias("bar"))
    return want.join(bars, [*KEY, "bar"], "full_outer").withColumn("beat_length", F.coalesce("beat_length", F.lit(4.0)))


def insert_bars(target: DataFrame, source: DataFrame, mapping: DataFrame) -> DataFrame:
    """target with the bars that mapping (piece_id, src_track, src_bar, dst_track, dst_bar) takes from source."""
    place = mapping.select("piece_id", F.col("dst_track").alias("track"), F.col("dst_bar").alias("bar")).distinct()
    new = source.join(mapping.withColumnsRenamed({"src_track": "track", "src_bar": "bar"}), [*KEY, "bar"])
    new = new.drop("track", "bar").withColumnsRenamed({"dst_track": "track", "dst_bar": "bar"})
    return target.join(place, [*KEY, "bar"], "left_anti").unionByName(new)


def override_features(features: DataFrame, controls: DataFrame, columns: list[str]) -> DataFrame:
    """Computed features, replaced where a control level (1-based, 0 is any) is given."""
    c = controls.select(*KEY, *[F.col(x).alias(f"_{x}") for x in columns])
    df = features.join(c, KEY, "left")
    return df.withColumns({x: F.when(F.col(f"_{x}") > 0, F.col(f"_{x}") - 1).otherwise(F.col(x)) for x in columns}).drop(*[f"_{x}" for x in columns])


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(piece_id, field, value): values outside their range."""
    tests = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), (~F.col(c).between(*r)).alias("bad")) for c, r in ranges.items()])
    return df.select("piece_id", F.explode(F.filter(tests, lambda t: t["bad"])).alias("x")).select("piece_id", "x.field", "x.value")


def event_violations(events: DataFrame, length: Column) -> DataFrame:
    """Onsets outside [0, length), offsets outside [0, length]."""
    on = (F.col("velocity") > 0) & ~((F.col("time") >= 0) & (F.col("time") < length))
    return events.where(on | ((F.col("velocity") == 0) & ~F.col("time").between(F.lit(0), length)))


def unequal_lengths(bars: DataFrame) -> DataFrame:
    """Pieces whose tracks have different numbers of bars."""
    n = bars.groupBy(*KEY).agg(F.count_distinct("bar").alias("n"))
    return n.groupBy("piece_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least < most")


def unequal_signatures(bars: DataFrame) -> DataFrame:
    """(piece_id, bar) where tracks differ in time signature."""
    return bars.groupBy("piece_id", "bar").agg(F.count_distinct("ts_num", "ts_den").alias("signatures")).where("signatures > 1")


def status_violations(status: DataFrame, tracks: DataFrame, model_dim: int) -> DataFrame:
    """(piece_id, track, problem) of generation requests: status (piece_id, track, selected, autoregressive, ignore) against tracks (piece_id, track)."""
    n = F.size(F.filter("selected", lambda x: x))
    kind = F.when(n == 0, "CONDITION").when(n == F.size("selected"), "RESAMPLE").otherwise("INFILL")
    known = tracks.select(*KEY).distinct().withColumn("_known", F.lit(True))
    df = status.join(known, KEY, "left").withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    tests = {
        "too few bars": F.size("selected") < model_dim, "unknown track": (kind != "RESAMPLE") & F.col("_known").isNull(), "autoregressive needs all bars": F.col("autoregressive") & (kind != "RESAMPLE"),
        "ignored but selected": F.col("ignore") & (n > 0), "track twice": F.col("_same") > 1,
    }
    rows = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    return df.select(*KEY, F.explode(rows).alias("problem"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one and not, or less often, in the other: none for identical bars or tracks."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def identical_tracks(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(piece_id, track, identical) by an order-insensitive digest of the events."""
    digest = lambda df, n: df.groupBy(*KEY).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias(f"h{n}"), F.count(F.lit(1)).alias(f"n{n}"))
    both = digest(left, 1).join(digest(right, 2), KEY, "full_outer")
    return both.select(*KEY, (F.col("h1").eqNullSafe(F.col("h2")) & F.col("n1").eqNullSafe(F.col("n2"))).alias("identical"))


def masks(status: DataFrame) -> DataFrame:
    """(piece_id, selection, resample, ignored): matrices of a request in track order."""
    resample = F.transform("selected", lambda _: F.col("autoregressive"))
    rows = status.select("piece_id", F.struct("track", "selected", resample.alias("resample"), F.transform("selected", lambda _: F.col("ignore")).alias("ignored")).alias("x"))
    df = rows.groupBy("piece_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return df.select("piece_id", F.col("xs.selected").alias("selection"), F.col("xs.resample").alias("resample"), F.col("xs.ignored").alias("ignored"))


# Ranges of a piece's fields and of a generation request's parameters.
PIECE_RANGES = {"resolution": (1, 960), "tempo": (1, 1000)}
EVENT_RANGES = {"pitch": (0, 127), "velocity": (0, 127)}
BAR_RANGES = {"ts_num": (1, 255), "ts_den": (1, 255)}
PARAM_RANGES = {"temperature": (0.5, 2.0), "percentage": (0, 100), "tracks_per_step": (1, 12), "bars_per_step": (1, 8), "model_dim": (1, 8)}


def any_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Whether a group has a true value; groups of nulls have none."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(column), F.lit(False)).alias("any"))


def all_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Whether all of a group's values are true; nulls don't count."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(column), F.lit(True)).alias("all"))


def sameness(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, all_same, all_different) of a column's values by group."""
    n = F.count_distinct(column)
    return df.groupBy(*keys).agg((n <= 1).alias("all_same"), (n == F.count(column)).alias("all_different"))


def in_domain(column: Column, domain: list) -> Column:
    return F.coalesce(column.isin(*domain), F.lit(False))


def param_violations(params: DataFrame, key: str = "piece_id") -> DataFrame:
    """(piece_id, field, value) of parameters out of range; a window smaller than its step counts as model_dim's fault."""
    out = range_violations(params.withColumnRenamed(key, "piece_id"), {k: v for k, v in PARAM_RANGES.items() if k in params.columns})
    small = params.where(F.col("bars_per_step") > F.col("model_dim")).select(F.col(key).alias("piece_id"), F.lit("model_dim").alias("field"), F.col("model_dim").cast("double").alias("value"))
    return out.unionByName(small).distinct()


def validate(t: dict[str, DataFrame]) -> DataFrame:
    """(piece_id, problem): the first test that a piece fails, in order: resolution, ranges, lengths, signatures, events.

    t: pieces (piece_id, resolution, tempo), bars (piece_id, track, bar, ts_num, ts_den), events (piece_id, track, bar, time, velocity, pitch).
    """
    pieces, bars, events = t["pieces"], t["bars"], t["events"]
    length = F.floor(F.col("ts_num") / F.col("ts_den") * 4 * F.col("resolution"))
    placed = events.join(bars.select(*KEY, "bar", "ts_num", "ts_den"), [*KEY, "bar"]).join(pieces.select("piece_id", "resolution"), "piece_id")
    tests = [
        pieces.where(F.coalesce("resolution", F.lit(0)) == 0).select("piece_id", F.lit(0).alias("rank"), F.lit("no resolution").alias("problem")),
        range_violations(pieces, PIECE_RANGES).unionByName(range_violations(bars, BAR_RANGES)).unionByName(range_violations(events, EVENT_RANGES)).select("piece_id", F.lit(1).alias("rank"), F.concat("field", F.lit(" out of range")).alias("problem")),
        unequal_lengths(bars).select("piece_id", F.lit(2).alias("rank"), F.lit("tracks differ in bars").alias("problem")),
        unequal_signatures(bars).select("piece_id", F.lit(3).alias("rank"), F.lit("tracks differ in time signature").alias("problem")),
        event_violations(placed, length).select("piece_id", F.lit(4).alias("rank"), F.lit("event outside its bar").alias("problem")),
    ]
    rows = tests[0]
    for x in tests[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("piece_id").agg(F.min(F.struct("rank", "problem")).alias("x")).select("piece_id", "x.problem")


def valid(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of pieces that pass validate, in order: events sorted, beat lengths set."""
    bad = validate(t)
    out = {k: v.join(bad.select("piece_id"), "piece_id", "left_anti") for k, v in t.items()}
    order = Window.partitionBy(*KEY, "bar").orderBy("time", F.least("velocity", F.lit(1)), "pitch")
    return out | {"bars": out["bars"].withColumn("beat_length", F.col("ts_num") / F.col("ts_den") * 4), "events": out["events"].withColumn("pos", F.row_number().over(order) - 1)}


def asserted(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same, but a piece that fails is an error where its pieces row is read."""
    bad = validate(t).withColumnRenamed("problem", "_problem")
    told = F.when(F.col("_problem").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("piece_id").cast("string"), "_problem")).cast("int"))
    pieces = t["pieces"].join(bad, "piece_id", "left").withColumn("resolution", F.coalesce(told, F.col("resolution"))).drop("_problem")
    return t | {"pieces": pieces}


def num_bars(bars: DataFrame) -> DataFrame:
    """(piece_id, n_bars); an error for a piece whose tracks differ."""
    n = bars.groupBy(*KEY).agg(F.count_distinct("bar").alias("n")).groupBy("piece_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    told = F.raise_error(F.concat(F.lit("tracks differ in bars: "), F.col("piece_id").cast("string"))).cast("long")
    return n.select("piece_id", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(told).alias("n_bars"))
