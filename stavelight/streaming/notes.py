"""Open notes as streaming state: onsets and offsets that arrive in any order, in any micro-batch, to notes.

A key is a (piece, track, pitch); keys are dealt into slots by their hash, and a slot is what has state and a timer, so that a call of the state store serves many
keys. A slot's events wait as Arrow buffers, one a micro-batch, until the watermark has passed them, then they are taken in their order within each key, so the
notes are those that ``operators.notes.pair_notes`` makes of the whole table. What a slot keeps is its waiting events and, for each key, the one onset that may
still be open; one timer wakes it when the watermark reaches its earliest event, or when an open note has hung for too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["piece_id", "track", "pitch"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Slots that keys are dealt into. A stream keeps the number it began with.
SLOTS = 1024
#: An event as it waits. Keys are text there and become what they were on the way out.
EVENT = pa.schema([*[(c, pa.string()) for c in KEY], ("ms", pa.int64()), ("tick", pa.int64()), ("velocity", pa.int64()), ("seq", pa.int64())])


def _packed(t: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, EVENT) as w:
        w.write_table(t)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(row) -> pa.Table:
    return pa.ipc.open_stream(bytes(row[0])).read_all()


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


class OpenNotes(StatefulProcessor):
    """hang: milliseconds of event time after which an onset without an end is given out as hanging; None never does."""

    def __init__(self, hang: int | None):
        self.hang = hang

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "events binary")
        self.open = handle.getValueState("open", "onsets binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        first = None
        for df in rows:
            df = df[df["ms"] >= now]  # what is late can't be put in order any more
            if len(df):
                self.pending.appendValue(_packed(pa.Table.from_pandas(df[EVENT.names], schema=EVENT, preserve_index=False)))
                least = int(df["ms"].min())
                first = least if first is None else min(first, least)
        self._wake(first, now)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = pa.concat_tables([_unpacked(r) for r in self.pending.get()] if self.pending.exists() else [EVENT.empty_table()])
        held = _unpacked(self.open.get()) if self.open.exists() else EVENT.empty_table()
        passed = _numbers(waiting, "ms") <= now
        ready, rest = waiting.filter(pa.array(passed)), waiting.filter(pa.array(~passed))
        if len(ready):
            self.pending.clear()
            if len(rest):
                self.pending.appendValue(_packed(rest))
        notes, held = self._notes(held, ready, now)
        if len(held):
            self.open.update(_packed(held))
        elif self.open.exists():
            self.open.clear()
        times = [int(_numbers(rest, "ms").min())] if len(rest) else []
        times += [int(_numbers(held, "ms").min()) + self.hang] if len(held) and self.hang else []
        self._wake(min(times, default=None), now)
        if len(notes):
            yield notes

    def _notes(self, held: pa.Table, ready: pa.Table, now: int) -> tuple[pd.DataFrame, pa.Table]:
        """Notes that end or have hung too long by now, and the onsets still open. An open onset stands before its key's events; each event closes or replaces the one before."""
        t = pa.concat_tables([held, ready]).combine_chunks()
        own = [t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in KEY]
        velocity = _numbers(t, "velocity")
        order = np.lexsort((_numbers(t, "seq"), np.minimum(velocity, 1), _numbers(t, "tick"), np.arange(len(t)) >= len(held), *own[::-1]))
        ms, up = _numbers(t, "ms")[order], velocity[order] > 0
        follows = np.ones(max(len(t) - 1, 0), bool)
        for k in own:
            follows &= k[order][1:] == k[order][:-1]
        # each onset with the time of its key's next event, or now
        has_next = np.append(follows, False) if len(t) else follows
        until = np.where(has_next, np.append(ms[1:], now) if len(t) else ms, now)
        hung = up & (until - ms >= self.hang) if self.hang else np.zeros(len(t), bool)
        closed = up & ~hung & has_next & ~(np.append(up[1:], True) if len(t) else up)
        still = up & ~hung & ~has_next
        out = np.flatnonzero(closed | hung)
        rows = t.take(pa.array(order[out]))
        ends = t.column("tick").take(pa.array(np.where(closed, np.append(order[1:], 0) if len(t) else order, order)[out]))
        notes = rows.select(KEY).to_pandas()
        notes["start"] = _numbers(rows, "tick").astype(np.int32)
        notes["end"] = pd.arrays.IntegerArray(ends.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int32), hung[out])
        notes["velocity"] = _numbers(rows, "velocity").astype(np.int32)
        notes["hanging"] = hung[out]
        return notes, t.take(pa.array(order[np.flatnonzero(still)]))

    def _wake(self, time: int | None, now: int) -> None:
        """One timer a slot, the earliest; those that now has reached are about to go."""
        if time is None:
            return
        later = [t for t in self.handle.listTimers() if t > now]
        if later and min(later) <= time:
            return
        for t in later:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(time)

    def close(self) -> None:
        pass


def streamed_notes(events: DataFrame, late: str = "10 minutes", hang: int | None = None, slots: int = SLOTS) -> DataFrame:
    """(piece_id, track, pitch, start, end, velocity, hanging) of a stream of (ts, piece_id, track, pitch, tick, velocity, seq).

    A note is given out once the watermark, ``late`` behind the latest ts, has passed its offset; ts and tick rise together. Onsets that another onset of the pitch
    follows, and offsets without an onset, make no note. hang: after so many milliseconds of ts an onset without an end gives a row with a null end; an offset
    that comes later finds it gone. Events behind the watermark are left out. The session's state store has to be RocksDB (``use_rocks``).
    """
    rows = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    slot = F.pmod(F.xxhash64(*KEY), F.lit(slots)).cast("int")
    rows = rows.select("ts", slot.alias("slot"), *[F.col(c).cast("string").alias(c) for c in KEY], "ms", *[F.col(c).cast("long").alias(c) for c in ("tick", "velocity", "seq")])
    schema = "piece_id string, track string, pitch string, start int, `end` int, velocity int, hanging boolean"
    notes = rows.groupBy("slot").transformWithStateInPandas(OpenNotes(hang), schema, "Append", "EventTime")
    return notes.select(*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in KEY], "start", "end", "velocity", "hanging")


def use_rocks(spark) -> None:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
