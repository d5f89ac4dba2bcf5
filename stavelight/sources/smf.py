"""Standard MIDI Files as tables, and back.

``read`` lists files with Spark's binaryFile source, so any file system works, and decodes each file in an Arrow pass: one row per message.
``pieces`` turns messages into the canonical tables with windows only. ``to_bytes`` is the inverse sink: one file per piece as a binary column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import bars as B
from ..operators import notes as N
from ..session import spread

SCHEMA = "piece_id string, tpq int, smf_track int, seq int, tick long, status int, channel int, p1 int, p2 int, meta_type int, meta binary, error string"


def read_vlq(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a variable-length number of at most five bytes."""
    value = 0
    for i in range(5):
        b = data[at + i]
        value = value << 7 | b & 0x7F
        if b < 0x80:
            return value, at + i + 1
    raise ValueError("variable-length number of more than five bytes")


def write_vlq(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def parse(data: bytes) -> Iterator[tuple]:
    """(tpq, track, seq, tick, status, channel, p1, p2, meta type, meta) of each message; ValueError on a bad file."""
    if data[:4] != b"MThd":
        raise ValueError("no MThd header")
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    if len(data) < 14:
        raise ValueError("file ends in its header")
    if number(4, 4) != 6:
        raise ValueError("header size is not 6")
    kind, tracks, division = number(8, 2), number(10, 2), number(12, 2)
    if kind not in (0, 1) or kind == 0 and tracks != 1:
        raise ValueError(f"type {kind} with {tracks} tracks")
    tpq = (256 - (division >> 8)) * (division & 0xFF) if division & 0x8000 else division
    at, seq = 14, 0
    for track in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError(f"no MTrk at byte {at}")
        end = at + 8 + number(at + 4, 4)
        if end > len(data):
            raise ValueError("track beyond the end of the file")
        at, tick, running = at + 8, 0, 0
        while at < end:
            delta, at = read_vlq(data, at)
            tick += delta
            status = data[at]
            if status < 0x80:
                if not 0x80 <= running < 0xF0:
                    raise ValueError(f"data byte without a status at byte {at}")
                status = running
            else:
                at += 1
            running = status
            row = [None, None, None, None]
            if status == 0xFF:
                row[2] = data[at]
                size, at = read_vlq(data, at + 1)
                row[3], at = data[at : at + size], at + size
            elif status in (0xF0, 0xF7):
                size, at = read_vlq(data, at)
                row[3], at = data[at : at + size], at + size
            elif status < 0xF0:
                n = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
                if any(b > 0x7F for b in data[at : at + n]):
                    raise ValueError(f"data byte over 127 at byte {at}")
                row[0], row[1], at = data[at], data[at + 1] if n == 2 else 0, at + n
            else:
                at += {0xF1: 1, 0xF2: 2, 0xF3: 1}.get(status, 0)
            yield tpq, track, seq, tick, status, (status & 15 if status < 0xF0 else None), *row
            seq += 1
        at = end


def plain_bytes(data: bytes) -> bytes:
    """A file's bytes: those that a text describes if the file doesn't begin like a binary one."""
    if not data or data[:1] == b"M":
        return data
    from .edit import from_binasc

    return from_binasc(data.decode("latin-1"))


TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.string()]
#: Messages of a batch.
ROWS = 65_536


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def error_batch(piece: str, error: Exception) -> pa.RecordBatch:
    return _batch([(piece, *[None] * 10, str(error) or "file ends early")])


def file_batches(piece: str, data: bytes) -> list[pa.RecordBatch]:
    """A file's messages, of which no more than a batch are Python objects at once; one row with the error of a bad file."""
    try:
        messages = ((piece, r[0], *r[1:], None) for r in parse(plain_bytes(data)))
        return [_batch(rows) for rows in iter(lambda: list(islice(messages, ROWS)), [])]
    except (ValueError, IndexError) as e:
        return [error_batch(piece, e)]


def decode(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Messages of files (name, content). A bad file gives one row with the error and nothing else, for quarantine."""

    def run(batches):
        for b in batches:
            for piece, data in zip(*b.columns, strict=True):
                yield from file_batches(piece.as_py(), data.as_py() or b"")

    return files.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, glob: str = "*.mid") -> DataFrame:
    """Messages of all files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return decode(files)


def tempos(messages: DataFrame) -> DataFrame:
    return messages.where("status = 255 and meta_type = 81").select("piece_id", F.col("tick").cast("int").alias("tick"), F.conv(F.hex("meta"), 16, 10).cast("int").alias("micros"))


def signatures(messages: DataFrame) -> DataFrame:
    byte = lambda i: F.conv(F.hex(F.substring("meta", i, 1)), 16, 10).cast("int")
    rows = messages.where("status = 255 and meta_type = 88 and length(meta) >= 2")
    return rows.select("piece_id", F.col("tick").cast("int").alias("tick"), byte(1).alias("ts_num"), F.pow(F.lit(2), byte(2)).cast("int").alias("ts_den"))


def linked_notes(messages: DataFrame) -> DataFrame:
    """(piece_id, smf_track, channel, key, velocity, seq, on_tick, off_tick): note-ons with their note-off; off_tick null without one."""
    on, off = S.note_on(F.col("status"), F.col("p2")), S.note_off(F.col("status"), F.col("p2"))
    rows = B.carry_patches(messages).where(on | off)
    linked = N.lifo_rows(rows, ["piece_id", "smf_track", "channel", "p1"], ["seq"], on, off, seq="seq", tick="tick")
    return linked.select("piece_id", F.col("_seq").alias("off_seq"), "seq", "tpq", "smf_track", "channel", F.col("p1").alias("key"), F.col("p2").alias("velocity"), F.col("tick").alias("on_tick"), "instrument", F.col("_tick").alias("off_tick"))


def pieces(messages: DataFrame, resolution: int = 12, te: bool = False, cut=lambda df: df) -> dict[str, DataFrame]:
    """Canonical tables of parsed files: pieces, tracks, bars, events. cut: what ends the lineage of tables that others are made of.

    Ticks snap to ``resolution`` steps a quarter. Voices are (smf track, channel, instrument, track type) in order of their first note; drums last one step;
    melodic notes without an end are dropped, and so are ends at tick 0. pieces.problem tells files that cannot be quantised or have no notes.
    """
    good = messages.where("error is null")
    meta = good.groupBy("piece_id").agg(F.first("tpq").alias("tpq"), F.max("tick").cast("int").alias("last_tick"))
    tempo = tempos(good).groupBy("piece_id").agg(F.max_by("micros", "tick").alias("micros"))
    notes = linked_notes(good)
    kind = S.opz_track_type(F.col("channel"), F.col("instrument"), F.col("key")) if te else S.track_type_of_voice(F.col("channel"))
    notes = notes.withColumn("track_type", kind).withColumn("is_drum", S.is_drum_track(F.col("track_type"))).where("is_drum or off_tick is not null")
    voice = ["smf_track", "channel", "instrument", "track_type"]
    notes = cut(notes)
    first = notes.groupBy("piece_id", *voice).agg(F.min("seq").alias("_f"))
    tracks = first.withColumn("track", F.row_number().over(Window.partitionBy("piece_id").orderBy("_f")) - 1).drop("_f")
    spq = F.lit(resolution)
    snap = lambda c: S.quantize_step(c, F.col("tpq"), spq)
    tracks = cut(tracks)
    notes = notes.join(tracks, ["piece_id", *voice]).withColumns({"on": snap(F.col("on_tick")), "off": snap(F.col("off_tick"))})
    ends = F.when(F.col("is_drum"), F.col("on") + 1).otherwise(F.col("off"))
    struct = F.array(F.struct(F.col("on").alias("tick"), F.col("velocity").alias("velocity"), (F.col("seq") * 2).alias("seq")), F.struct(ends.alias("tick"), F.lit(0).alias("velocity"), (F.col("seq") * 2 + 1).alias("seq")))
    events = cut(notes.select("piece_id", "track", F.col("key").alias("pitch"), F.explode(struct).alias("e")).select("piece_id", "track", "pitch", "e.*").where("velocity > 0 or tick > 0"))
    length = events.groupBy("piece_id").agg(F.max("tick").alias("max_tick")).withColumn("tpq", F.lit(resolution))
    sig = signatures(good).join(meta.select("piece_id", "tpq"), "piece_id").withColumn("tick", snap(F.col("tick"))).drop("tpq")
    grid = cut(B.bar_grid(sig, length.withColumn("max_tick", F.greatest("max_tick", F.lit(1)))))
    placed = B.events_to_bars(events, grid).withColumn("time", F.col("tick") - F.col("bar_start"))
    table = meta.join(tempo, "piece_id", "left").join(length.select("piece_id", F.lit(True).alias("_notes")), "piece_id", "left")
    problem = F.when(F.col("tpq") < resolution, "too few ticks a quarter").when(F.col("_notes").isNull(), "no notes")
    return {
        "pieces": table.select("piece_id", "tpq", F.lit(resolution).alias("resolution"), F.coalesce(F.floor(S.tempo_bpm(F.col("micros"))).cast("int"), F.lit(120)).alias("tempo"), problem.alias("problem")),
        "tracks": tracks, "bars": grid, "events": placed,
    }


def message(status: int, *data: int) -> bytes:
    return bytes([status, *data])


def meta_message(kind: int, content: bytes) -> bytes:
    return bytes([0xFF, kind]) + write_vlq(len(content)) + content


def tempo_message(bpm: float) -> bytes:
    return meta_message(0x51, round(6e7 / bpm).to_bytes(3, "big"))


def signature_message(num: int, den: int, clocks: int = 24) -> bytes:
    return meta_message(0x58, bytes([num, den.bit_length() - 1, clocks, 8]))


def serialise(tracks: list[list[tuple[int, bytes]]], tpq: int) -> bytes:
    """A type 1 file of (tick, message) lists; ends of track are added."""
    out = [b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(tracks).to_bytes(2, "big") + tpq.to_bytes(2, "big")]
    for rows in tracks:
        body, last = [], 0
        for tick, m in sorted(rows, key=lambda r: r[0]):
            if m[:2] != b"\xff\x2f":
                body.append(write_vlq(tick - last) + m)
                last = tick
        data = b"".join(body) + b"\x00\xff\x2f\x00"
        out.append(b"MTrk" + len(data).to_bytes(4, "big") + data)
    return b"".join(out)


def file_bytes(heads: list[bytes], track: np.ndarray, tick: np.ndarray, status: np.ndarray, p1: np.ndarray, p2: np.ndarray, tpq: int) -> bytes:
    """A type 1 file: for each track its head, messages at tick 0, then its rows, which are in order of ticks, then its end."""
    for c, top in ((tick, 1 << 28), (p1, 256), (p2, 256)):
        if len(c) and (c.min() < 0 or c.max() >= top):
            raise ValueError(f"a number of a message is not in 0 to {top - 1}")
    order = np.argsort(track, kind="stable")
    track, tick = track[order], tick[order]
    delta = np.diff(tick, prepend=0)
    first = np.flatnonzero(np.diff(track, prepend=-1))
    delta[first] = tick[first]
    if len(delta) and delta.min() < 0:
        raise ValueError("rows of a track are not in order of ticks")
    n = 1 + sum((delta >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3))
    ends = np.cumsum(n + 3)
    at = ends - n - 3
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        some = n > k
        left = n[some] - 1 - k
        data[at[some] + k] = delta[some] >> 7 * left & 0x7F | np.where(left > 0, 0x80, 0)
    for k, c in enumerate((status, p1, p2)):
        data[at + n + k] = c[order]
    stops = [0, *(int(ends[i - 1]) if i else 0 for i in np.searchsorted(track, np.arange(len(heads)), "right"))]
    out = [b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(heads).to_bytes(2, "big") + tpq.to_bytes(2, "big")]
    for i, head in enumerate(heads):
        body = head + data[stops[i] : stops[i + 1]].tobytes() + b"\x00\xff\x2f\x00"
        out.append(b"MTrk" + len(body).to_bytes(4, "big") + body)
    return b"".join(out)


def to_bytes(tracks: DataFrame, events: DataFrame, tempo: int = 120, resolution: int = 12, signatures: DataFrame | None = None) -> DataFrame:
    """(piece_id, content): a file per piece. tracks: piece_id, track, instrument, track_type; events: piece_id, track, tick, velocity, pitch.

    A piece is gathered in one task, as its file is; the number of tracks is at most 15, else content is null. A worker takes one piece after the other, its
    events as arrays of numbers.
    """
    head = spread(tracks, "piece_id").groupBy("piece_id").agg(F.sort_array(F.collect_list(F.struct("track", "instrument", S.is_drum_track(F.col("track_type")).alias("drum")))).alias("tracks"))
    body = spread(events, "piece_id").groupBy("piece_id").agg(F.sort_array(F.collect_list(F.struct("tick", F.least("velocity", F.lit(1)).alias("on"), "pitch", "track", "velocity"))).alias("events"))
    rows = head.join(body, "piece_id", "left")
    if signatures is not None:
        rows = rows.join(signatures.groupBy("piece_id").agg(F.collect_list(F.struct("tick", "ts_num", "ts_den")).alias("sigs")), "piece_id", "left")

    def content(tracks: list[dict], events, sigs: list[dict]) -> bytes | None:
        if len(tracks) > 15:
            return None
        place = {t["track"]: i for i, t in enumerate(tracks)}
        channel = {t["track"]: 9 if t["drum"] else fixed.SAFE_CHANNELS[place[t["track"]]] for t in tracks}
        first, last = [b"\x00" + tempo_message(tempo)], 0
        for s in sorted(sigs, key=lambda s: s["tick"]):
            first.append(write_vlq(s["tick"] - last) + signature_message(s["ts_num"], s["ts_den"]))
            last = s["tick"]
        heads: list[list[bytes]] = [first, *([] for _ in tracks)]
        for t in tracks:
            heads[place[t["track"]] + 1].append(b"\x00" + message(0xC0 | channel[t["track"]], t["instrument"]))
        if events is None:
            events = pa.array([], pa.struct([(c, pa.int32()) for c in ("tick", "pitch", "track", "velocity")]))
        column = lambda c: pc.struct_field(events, c)
        if any(column(c).null_count for c in ("tick", "pitch", "track", "velocity")):
            raise ValueError("an event has a null")
        code = column("track").dictionary_encode()
        own = [t.as_py() for t in code.dictionary]
        i = code.indices.to_numpy()
        status = np.array([0x90 | channel[t] for t in own], np.int64)
        number = lambda c: column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        return file_bytes([b"".join(h) for h in heads], np.array([place[t] + 1 for t in own], np.int64)[i], number("tick"), status[i], number("pitch"), number("velocity"), resolution)

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out = []
            for i in range(b.num_rows):
                sigs = cols["sigs"][i].as_py() if "sigs" in cols else None
                out.append(content(cols["tracks"][i].as_py(), cols["events"][i].values, sigs or []))
            yield pa.RecordBatch.from_arrays([cols["piece_id"], pa.array(out, pa.binary())], names=["piece_id", "content"])

    kind = tracks.schema["piece_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"piece_id {kind}, content binary")


def durations(messages: DataFrame) -> DataFrame:
    """(piece_id, tick, duration, smf_track, key) of each note-on; 0 if nothing ends it."""
    return linked_notes(messages).select("piece_id", F.col("on_tick").alias("tick"), F.coalesce(F.col("off_tick") - F.col("on_tick"), F.lit(0).cast("long")).alias("duration"), "smf_track", "key")


def with_seconds(messages: DataFrame) -> DataFrame:
    files = messages.where("error is null").select("piece_id", "tpq").distinct()
    return B.with_seconds(messages.where("error is null"), B.tempo_map(tempos(messages), files))


def file_duration(messages: DataFrame) -> DataFrame:
    """(piece_id, max_tick, quarters, seconds)."""
    return with_seconds(messages).groupBy("piece_id").agg(F.max("tick").alias("max_tick"), (F.max("tick") / F.first("tpq")).alias("quarters"), F.max("seconds").alias("seconds"))


def retick(messages: DataFrame, tpq: int) -> DataFrame:
    return messages.withColumns({"tick": F.floor(F.col("tick") * tpq / F.col("tpq") + 0.5), "tpq": F.lit(tpq)})


def stretch(messages: DataFrame, factor: float) -> DataFrame:
    return messages.withColumn("tick", F.floor(F.col("tick") * factor + 0.5))


def lyrics(messages: DataFrame) -> DataFrame:
    return messages.where("status = 255 and meta_type = 5").select("piece_id", "tick", F.decode("meta", "UTF-8").alias("text"))


def join_tracks(messages: DataFrame) -> DataFrame:
    """One track, in order of ticks; the old one stays in split_track."""
    w = Window.partitionBy("piece_id").orderBy("tick", "smf_track", "seq")
    return messages.withColumns({"split_track": F.col("smf_track"), "seq": F.row_number().over(w) - 1, "smf_track": F.lit(0)})


def split_tracks(messages: DataFrame) -> DataFrame:
    return messages.withColumn("smf_track", F.col("split_track"))


def split_by_channel(messages: DataFrame) -> DataFrame:
    """Meta messages in track 0, each channel in a track of its own."""
    return messages.withColumn("smf_track", F.coalesce(F.col("channel") + 1, F.lit(0)))


def excerpt(notes: DataFrame, start: int, end: int) -> DataFrame:
    """Notes (start, end) of a time slice, cut at its ends and moved to 0."""
    df = notes.where((F.col("start") < end) & (F.col("end") > start))
    return df.withColumns({"end": F.least("end", F.lit(end)) - start, "start": F.greatest("start", F.lit(start)) - start})


def performance_kind(onsets: DataFrame) -> DataFrame:
    """(piece_id, kind) by the variety of onset gaps: few distinct gaps are quantized, many performed."""
    w = Window.partitionBy("piece_id").orderBy("tick")
    gaps = onsets.select("piece_id", "tick").distinct().withColumn("gap", F.col("tick") - F.lag("tick").over(w)).where("gap is not null")
    df = gaps.groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gap").alias("d"))
    share = F.col("d") / F.col("n")
    return df.select("piece_id", F.when(F.col("n") < 10, "Unknown").when(share < 0.2, "Quantized").when(share > 0.5, "Performance").otherwise("Unknown").alias("kind"))


def hex_dump(files: DataFrame, content: str = "content") -> Column:
    return F.regexp_replace(F.hex(content), "(..)(?=.)", "$1 ")
