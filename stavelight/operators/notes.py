"""Onsets and offsets to notes: pairing, durations, hanging notes, monophony.

Events: piece_id, track, pitch, tick (absolute step), velocity (0 is an offset) and seq, their order within a tick. Everything is one window over
(piece_id, track, pitch) or (piece_id, track): one shuffle, and the partitioning serves all later steps by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["piece_id", "track"]


def event_order() -> list[Column]:
    """(time, offsets first, pitch), then file order."""
    return [F.col("tick"), F.least("velocity", F.lit(1)), F.col("pitch"), F.col("seq")]


def by_pitch() -> Window:
    return Window.partitionBy(*KEY, "pitch").orderBy("tick", F.least("velocity", F.lit(1)), "seq")


def reindex(events: DataFrame) -> DataFrame:
    """Events with pos, their place in a piece's order."""
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("piece_id").orderBy("tick", F.least("velocity", F.lit(1)), "pitch", "track", "seq")) - 1)


def pair_notes(events: DataFrame, drum: Column | None = None, onsetless: bool = False, bar_start: Column | None = None) -> DataFrame:
    """(piece_id, track, pitch, start, end, velocity): a note for each offset whose previous event of the pitch is an onset.

    A second onset replaces an open one. drum: tracks whose onsets last one step, offsets ignored. onsetless: offsets without an onset count from bar_start.
    """
    w = by_pitch()
    df = events.withColumns({"_on": F.lag("tick").over(w), "_v": F.lag("velocity").over(w)})
    drum = F.lit(False) if drum is None else drum
    paired = (F.col("velocity") == 0) & (F.col("_v") > 0)
    loose = (F.col("velocity") == 0) & (F.coalesce("_v", F.lit(0)) == 0) if onsetless else F.lit(False)
    start = F.when(drum, F.col("tick")).when(paired, F.col("_on")).otherwise(F.lit(0) if bar_start is None else bar_start)
    rows = df.where(F.when(drum, F.col("velocity") > 0).otherwise(paired | loose))
    return rows.select(*KEY, "pitch", start.alias("start"), F.when(drum, F.col("tick") + 1).otherwise(F.col("tick")).alias("end"), F.when(drum, F.col("velocity")).otherwise(F.coalesce("_v", F.lit(0))).alias("velocity"))


def link_events(events: DataFrame) -> DataFrame:
    """(piece_id, track, onset_seq, offset_seq) of the pairs."""
    w = by_pitch()
    df = events.withColumns({"_s": F.lag("seq").over(w), "_v": F.lag("velocity").over(w)})
    return df.where("velocity = 0 and _v > 0").select(*KEY, F.col("_s").alias("onset_seq"), F.col("seq").alias("offset_seq"))


def note_durations(events: DataFrame, drum: Column | None = None) -> DataFrame:
    """Onsets with duration: to the last offset before the pitch's next onset, 0 without one, 1 on drums."""
    w = Window.partitionBy(*KEY, "pitch").orderBy("tick", F.least("velocity", F.lit(1)), "seq")
    df = events.withColumn("_run", F.sum((F.col("velocity") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*KEY, "pitch", "_run")
    df = df.withColumn("_last", F.max(F.when(F.col("velocity") == 0, F.col("tick"))).over(run)).where("velocity > 0")
    drum = F.lit(False) if drum is None else drum
    return df.withColumn("duration", F.when(drum, 1).otherwise(F.coalesce(F.col("_last") - F.col("tick"), F.lit(0)))).drop("_run", "_last")


def drop_hanging_onsets(events: DataFrame, drum: Column | None = None, ignore_drums: bool = True) -> DataFrame:
    """Events without onsets that the pitch's next event doesn't close."""
    following = F.lead("velocity").over(by_pitch())
    spared = F.lit(False) if drum is None or not ignore_drums else drum
    return events.withColumn("_next", following).where(spared | (F.col("velocity") == 0) | (F.col("_next") == 0)).drop("_next")


def force_monophonic(events: DataFrame) -> DataFrame:
    """(piece_id, track, pitch, start, end, velocity): a later onset ends the sounding note, one at the same tick replaces it, a trailing open note goes."""
    track = Window.partitionBy(*KEY).orderBy("tick", "pitch", "seq")
    onsets = events.where("velocity > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "tick").orderBy(F.desc("pitch"), F.desc("seq")))).where("_r = 1")
    onsets = onsets.withColumn("_next", F.lead("tick").over(track))
    offsets = events.where("velocity = 0").select("piece_id", "track", "pitch", F.col("tick").alias("_off"))
    own = onsets.join(offsets, ["piece_id", "track", "pitch"], "left")
    closed = own.groupBy(*KEY, "pitch", "tick", "velocity", "seq", "_next").agg(F.min(F.when(F.col("_off") > F.col("tick"), F.col("_off"))).alias("_off"))
    return closed.select(*KEY, "pitch", F.col("tick").alias("start"), F.least("_off", "_next").alias("end"), "velocity").where("end is not null")


def link_lifo(messages: DataFrame, keys: list[str], order: list[str], on: Column, off: Column, seq: str = "seq") -> DataFrame:
    """(keys, on_seq, off_seq): each closing message ends the most recent open one.

    Depth is the running sum of +1 and -1, held at 0; an opening at depth d meets the first later closing that starts from depth d. With
    depth as a partition key that is the next row. Closings at depth 0 have no partner.
    """
    df = lifo_rows(messages, keys, order, on, off, seq=seq)
    return df.where("_seq is not null").select(*keys, F.col(seq).alias("on_seq"), F.col("_seq").alias("off_seq"))


def lifo_rows(messages: DataFrame, keys: list[str], order: list[str], on: Column, off: Column, **told: str) -> DataFrame:
    """Opening messages, each with columns of what closes it, nulls for what nothing does. told: for each of these columns ``_name`` the column it is."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = messages.withColumn("_x", F.when(on, 1).when(off, -1)).where("_x is not null")
    df = df.withColumn("_s", F.sum("_x").over(w))
    df = df.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    # a closing's depth before it: one more than after, unless it was held at 0
    low = F.least(F.lit(0), F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    before = F.col("_s") - F.col("_x") - F.coalesce(low, F.lit(0))
    df = df.withColumn("_level", F.when(F.col("_x") == 1, F.col("_d")).otherwise(before)).where("_level > 0")
    pair = Window.partitionBy(*keys, "_level").orderBy(*order)
    closed = F.lead("_x").over(pair) == -1
    df = df.withColumns({f"_{name}": F.when(closed, F.lead(c).over(pair)) for name, c in told.items()})
    return df.where("_x = 1").drop("_x", "_s", "_d", "_level")


#: Controllers with two states.
SWITCHES = (64, 65, 66, 67, 68, 69, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 90, 122)


def link_switches(messages: DataFrame, threshold: int = 64) -> DataFrame:
    """(piece_id, smf_track, channel, controller, on_seq, off_seq, on_tick, off_tick): each switching on of a two-state controller with what switches it off.

    A value of ``threshold`` or more is on. Messages that change nothing are passed over, as is off before any on; what is never switched off has no row. One
    window by controller finds the changes, which alternate from on to off, so an on's partner is the next of them.
    """
    keys = ["piece_id", "smf_track", "channel", "p1"]
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = messages.where(F.col("status").between(176, 191) & F.col("p1").isin(*SWITCHES)).withColumn("_on", F.col("p2") >= threshold)
    changes = rows.where("_on is not null").withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).where("_on <> _was")
    linked = changes.withColumns({"off_seq": F.lead("seq").over(w), "off_tick": F.lead("tick").over(w)}).where("_on and off_seq is not null")
    return linked.select("piece_id", "smf_track", "channel", F.col("p1").alias("controller"), F.col("seq").alias("on_seq"), "off_seq", F.col("tick").alias("on_tick"), "off_tick")


def melody(notes: DataFrame) -> DataFrame:
    """(piece_id, track, start, pitch): the line of the highest note at each onset; pitch is null where a rest begins.

    A note sounds until its end or the line's next onset; a rest fills what is between them, and one stands at the end of the last note. Of several notes of
    the highest pitch at an onset the longest counts. notes: piece_id, track, pitch, start, end.
    """
    top = notes.groupBy(*KEY, "start").agg(F.max(F.struct("pitch", "end")).alias("n")).select(*KEY, "start", "n.pitch", "n.end")
    top = top.withColumn("_next", F.lead("start").over(Window.partitionBy(*KEY).orderBy("start")))
    rest = F.when(F.col("_next").isNull() | (F.col("_next") > F.col("end")), F.struct(F.col("end").alias("start"), F.lit(None).cast("int").alias("pitch")))
    both = F.array_compact(F.array(F.struct("start", F.col("pitch").cast("int").alias("pitch")), rest))
    return top.select(*KEY, F.explode(both).alias("x")).select(*KEY, "x.start", "x.pitch")
