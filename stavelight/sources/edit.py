"""Building and editing message tables: builders, track surgery, concatenation, text forms.

A message table has the columns of ``smf.SCHEMA``. Edits are column rewrites and windows by piece; nothing is parsed again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import notes as N
from ..operators.segments import draw
from ..session import checkpointed
from . import smf

MESSAGE = "struct<tick:bigint,status:int,channel:int,p1:int,p2:int,meta_type:int,meta:binary>"
#: Kinds of text messages.
TEXTS = {"text": 1, "copyright": 2, "track_name": 3, "instrument_name": 4, "lyric": 5, "marker": 6, "cue": 7}
SUSTAIN = 64


def _n(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _voice(kind: int, tick: Column, channel: int | Column, p1: int | Column, p2: int | Column) -> Column:
    null = F.lit(None)
    return F.struct(tick, (F.lit(kind) + _n(channel)), _n(channel), _n(p1), _n(p2), null, null).cast(MESSAGE)


def note_on(tick, channel, key, velocity=64) -> Column:
    return _voice(0x90, _n(tick), channel, key, velocity)


def note_off(tick, channel, key, velocity=0) -> Column:
    return _voice(0x80, _n(tick), channel, key, velocity)


def controller(tick, channel, number, value) -> Column:
    return _voice(0xB0, _n(tick), channel, number, value)


def patch_change(tick, channel, program) -> Column:
    return _voice(0xC0, _n(tick), channel, program, 0)


def pitch_bend(tick, channel, amount) -> Column:
    """amount from -1 to 1, as 14 bits around 8192."""
    value = F.least(F.greatest(F.floor((_n(amount) + 1.0) * 8191.5 + 0.5).cast("int"), F.lit(0)), F.lit(16383))
    return _voice(0xE0, _n(tick), channel, value % 128, F.floor(value / 128).cast("int"))


def sustain(tick, channel, value) -> Column:
    return controller(tick, channel, SUSTAIN, value)


def sustain_on(tick, channel) -> Column:
    return sustain(tick, channel, 127)


def sustain_off(tick, channel) -> Column:
    return sustain(tick, channel, 0)


def meta(tick, kind: int, content: Column) -> Column:
    null = F.lit(None)
    return F.struct(_n(tick), F.lit(255), null, null, null, F.lit(kind), content.cast("binary")).cast(MESSAGE)


def text(tick, content, kind: str = "text") -> Column:
    return meta(tick, TEXTS[kind], F.encode(_n(content), "UTF-8"))


def tempo(tick, bpm) -> Column:
    micros = F.round(F.lit(6e7) / _n(bpm)).cast("bigint")
    return meta(tick, 0x51, F.unhex(F.lpad(F.hex(micros), 6, "0")))


def time_signature(tick, num: int | Column, den: int | Column, clocks: int = 24, thirty_seconds: int = 8) -> Column:
    byte = lambda c: F.lpad(F.hex(_n(c).cast("bigint")), 2, "0")
    power = F.round(F.log2(_n(den).cast("double"))).cast("int")
    return meta(tick, 0x58, F.unhex(F.concat(byte(num), byte(power), byte(clocks), byte(thirty_seconds))))


def compound_time_signature(tick, num, den) -> Column:
    return time_signature(tick, num, den, 36)


def add(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """messages with rows (piece_id, smf_track, m) behind those of their piece; ``order`` sorts them in."""
    last = messages.groupBy("piece_id").agg(F.max("seq").alias("_last"), F.first("tpq").alias("tpq"))
    w = Window.partitionBy("piece_id").orderBy("smf_track", "m.tick", "m.status", "m.p1", "m.p2", "m.meta_type")
    new = rows.withColumn("_i", F.row_number().over(w)).join(last, "piece_id", "left")
    new = new.select("piece_id", "tpq", "smf_track", (F.coalesce("_last", F.lit(-1)) + F.col("_i")).cast("int").alias("seq"), "m.tick", "m.status", "m.channel", "m.p1", "m.p2", "m.meta_type", "m.meta", F.lit(None).cast("string").alias("error"))
    return messages.select(*new.columns).unionByName(new)


def order(messages: DataFrame, keep: bool = True) -> DataFrame:
    """seq anew by track and tick: at one tick meta messages first, but for the end of track, then controls, note-offs, note-ons.

    keep: messages that this leaves equal stay in their order. Without it, as for messages that never had one, controllers stand by number and value first.
    """
    kind = F.floor(F.col("status") / 16)
    off = (kind == 8) | ((kind == 9) & (F.col("p2") == 0))
    rank = F.when((F.col("status") == 255) & (F.col("meta_type") == 47), 9).when(F.col("status") == 255, 0).when(off, 2).when(kind == 9, 3).otherwise(1)
    number = [] if keep else [F.when(kind == 11, F.col("p1")), F.when(kind == 11, F.col("p2"))]
    w = Window.partitionBy("piece_id").orderBy("smf_track", "tick", rank, *number, "seq")
    return messages.withColumn("seq", F.row_number().over(w) - 1)


def excerpt(messages: DataFrame, start: float, end: float) -> DataFrame:
    """Messages of the seconds [start, end) of each file, moved to tick 0, behind the state in force there: the tempo, and by track and channel the program and the
    last value of each controller. Note-offs of notes from before go; notes that still sound at the end are ended there, as the slice's other notes are.

    Seconds become ticks, rounded, by the file's own tempo map; files that end before ``start`` have their state only. Error rows go.
    """
    good = checkpointed(messages.where("error is null"))  # files are decoded once
    files = good.groupBy("piece_id").agg(F.first("tpq").alias("tpq"))
    tempo = B.tempo_map(smf.tempos(good), files)

    def at(seconds: float, name: str) -> DataFrame:
        last = tempo.where(F.col("seconds") <= seconds).groupBy("piece_id").agg(F.max_by(F.struct("tick", "seconds", "per_tick"), "tick").alias("t"))
        return last.select("piece_id", F.round(F.col("t.tick") + (seconds - F.col("t.seconds")) / F.col("t.per_tick")).cast("long").alias(name))

    rows = good.join(at(start, "_from"), "piece_id").join(at(end, "_till"), "piece_id")
    kind = F.floor(F.col("status") / 16)
    names = ["piece_id", "tpq", "smf_track", "status", "channel", "p1", "p2", "meta_type", "meta"]
    state = F.when((F.col("status") == 255) & (F.col("meta_type") == 81), F.lit("tempo")).when(kind == 12, F.concat_ws(":", F.lit("program"), "smf_track", "channel")).when(kind == 11, F.concat_ws(":", F.lit("controller"), "smf_track", "channel", "p1"))
    before = rows.where("tick < _from").withColumn("_state", state).where("_state is not null")
    last = Window.partitionBy("piece_id", "_state").orderBy(F.desc("tick"), F.desc("seq"))
    before = before.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*names, F.lit(0).cast("long").alias("tick"), F.lit(0).alias("_part"), "seq")
    inside = rows.where("tick >= _from and tick < _till and not (status = 255 and meta_type = 47)").withColumn("tick", F.col("tick") - F.col("_from"))
    on, off = smf.S.note_on(F.col("status"), F.col("p2")), smf.S.note_off(F.col("status"), F.col("p2"))
    keys = ["piece_id", "smf_track", "channel", "p1"]
    pairs = N.link_lifo(inside.where(on | off), keys, ["tick", "seq"], on, off)
    ends = pairs.select("piece_id", F.explode(F.array("on_seq", "off_seq")).alias("seq"), F.lit(True).alias("_paired"))
    inside = inside.join(ends, ["piece_id", "seq"], "left")
    # notes end by 0x80, or by 0x90 without velocity where the slice has more of those
    style = inside.groupBy("piece_id").agg((F.sum(F.when(off & (kind == 9), 1).otherwise(0)) > F.sum(F.when(off & (kind == 8), 1).otherwise(0))).alias("_nine"))
    open_ = inside.where(on & F.col("_paired").isNull()).join(style, "piece_id")
    closed = open_.withColumns({"status": F.col("channel") + F.when(F.col("_nine"), 144).otherwise(128), "p2": F.when(F.col("_nine"), 0).otherwise(64), "tick": F.col("_till") - F.col("_from")})
    kept = inside.where(~off | F.col("_paired")).select(*names, "tick", F.lit(1).alias("_part"), "seq")
    out = before.unionByName(kept).unionByName(closed.select(*names, "tick", F.lit(2).alias("_part"), "seq"))
    w = Window.partitionBy("piece_id").orderBy("smf_track", "tick", "_part", "seq")
    return out.withColumns({"seq": F.row_number().over(w) - 1, "error": F.lit(None).cast("string")}).select(*messages.columns)


def mixup(notes: DataFrame, seed: int | None = None, keys: tuple[str, ...] = ("piece_id",), order: tuple[str, ...] = ("track", "start", "pitch")) -> DataFrame:
    """notes with their pitches exchanged within each group: at random, or without a seed in reverse order; a group keeps its pitches, each as often.

    Two rankings of a group meet by an equality join, the notes' own and that of the pitches to be given out.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = notes.withColumn("_place", F.row_number().over(own))
    dealt = [F.desc("_place")] if seed is None else [draw(seed, *[F.col(k) for k in keys], F.col("_place")), F.col("_place")]
    given = rows.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(*dealt)).alias("_place"), F.col("pitch").alias("_pitch"))
    return rows.join(given, [*keys, "_place"]).withColumn("pitch", F.col("_pitch")).drop("_place", "_pitch").select(*notes.columns)


def without_empty(messages: DataFrame) -> DataFrame:
    """Messages that have any byte."""
    return messages.where("status is not null")


def delete_track(messages: DataFrame, track: int) -> DataFrame:
    """Without a track; those behind it move up."""
    t = F.col("smf_track")
    return messages.where(t.isNull() | (t != track)).withColumn("smf_track", F.when(t > track, t - 1).otherwise(t))


def merge_tracks(messages: DataFrame, first: int, second: int) -> DataFrame:
    """The second track's messages go to the first one's; tracks behind the second move up."""
    t = F.col("smf_track")
    return order(messages.withColumn("smf_track", F.when(t == second, first).otherwise(F.when(t > second, t - 1).otherwise(t))))


def insert_tracks(messages: DataFrame, n: int = 1, at: int | None = None) -> DataFrame:
    """Room for n tracks at a place, or behind the last one: each begins with an end-of-track message at tick 0."""
    size = messages.groupBy("piece_id").agg((F.max("smf_track") + 1).alias("_n"))
    df = messages.join(size, "piece_id")
    place = F.col("_n") if at is None else F.least(F.lit(at), F.col("_n"))
    moved = df.withColumn("smf_track", F.when(F.col("smf_track") >= place, F.col("smf_track") + n).otherwise(F.col("smf_track"))).drop("_n")
    new = size.select("piece_id", F.explode(F.sequence(place, place + (n - 1))).alias("smf_track")).withColumn("m", meta(0, 47, F.lit("")))
    return add(moved, new)


def counts(messages: DataFrame) -> DataFrame:
    """(piece_id, tracks, events, max_tick); of joined files the tracks before they were joined."""
    track = F.coalesce("split_track", "smf_track") if "split_track" in messages.columns else F.col("smf_track")
    return messages.where("status is not null").groupBy("piece_id").agg((F.max(track) + 1).cast("int").alias("tracks"), F.count(F.lit(1)).alias("events"), F.max("tick").alias("max_tick"))


def voice_counts(messages: DataFrame) -> DataFrame:
    """(piece_id, smf_track, channel, onsets, offsets) of each voice."""
    on, off = smf.S.note_on(F.col("status"), F.col("p2")), smf.S.note_off(F.col("status"), F.col("p2"))
    return messages.where(on | off).groupBy("piece_id", "smf_track", "channel").agg(F.sum(on.cast("int")).alias("onsets"), F.sum(off.cast("int")).alias("offsets"))


def concatenate(messages: DataFrame, listing: DataFrame, pad: int = 0) -> DataFrame:
    """Files one after the other: listing (piece_id, target, position). Ticks follow the target's first file; each file starts where the one before ends, ``pad`` ticks later.

    Tracks of one number join. Ends of track but the last file's go.
    """
    size = messages.where("status is not null").groupBy("piece_id").agg(F.first("tpq").alias("_tpq"), F.max("tick").alias("_end"))
    w = Window.partitionBy("target").orderBy("position", "piece_id")
    files = listing.join(size, "piece_id").withColumn("_to", F.first("_tpq").over(w))
    length = F.floor(F.col("_end") * F.col("_to") / F.col("_tpq") + 0.5) + pad
    files = files.withColumns({"_start": F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_place": F.row_number().over(w), "_last": F.count(F.lit(1)).over(Window.partitionBy("target"))})
    df = messages.where("status is not null").join(files.drop("_end"), "piece_id")
    df = df.where(~((F.col("status") == 255) & (F.col("meta_type") == 47) & (F.col("_place") < F.col("_last"))))
    tick = (F.floor(F.col("tick") * F.col("_to") / F.col("_tpq") + 0.5) + F.col("_start")).cast("long")
    seq = F.row_number().over(Window.partitionBy("target").orderBy("smf_track", "_place", "seq")) - 1
    return df.select(F.col("target").cast("string").alias("piece_id"), F.col("_to").alias("tpq"), "smf_track", seq.alias("seq"), tick.alias("tick"), "status", "channel", "p1", "p2", "meta_type", "meta", F.lit(None).cast("string").alias("error"))


def text_dump(messages: DataFrame) -> DataFrame:
    """(piece_id, seq, line): track, tick and message as text, bytes in hex."""
    byte = lambda c: F.lower(F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0"))
    one = (F.floor(F.col("status") / 16).isin(12, 13)) | (F.col("status") >= 240)
    data = F.when(F.col("status") == 255, F.concat_ws(" ", byte("meta_type"), F.lower(F.regexp_replace(F.hex("meta"), "(..)(?=.)", "$1 ")))).when(F.col("status") >= 240, F.lower(F.hex("meta"))).when(one, byte("p1")).otherwise(F.concat_ws(" ", byte("p1"), byte("p2")))
    return messages.where("status is not null").select("piece_id", "seq", F.rtrim(F.concat_ws(" ", F.col("smf_track").cast("string"), F.col("tick").cast("string"), byte("status"), data)).alias("line"))


def from_binasc(source: str) -> bytes:
    """Bytes of a text that describes them: hex bytes, decimals (60 as '60, two bytes as 2'120, little-endian as 2u'120), +c characters, "strings", 0,1 bits, v lengths,
    t tempos, p bends; the rest of a line after ; # or / is a comment."""
    out = bytearray()
    for line in source.splitlines():
        for word in re.findall(r'"[^"]*"|\+.|[;#/].*|[^\s;#]+', line):
            if word[0] in ";#/":
                break
            if word[0] == '"':
                out += word[1:-1].encode("latin-1", "replace")
            elif word[0] == "+" and len(word) == 2:
                out += word[1].encode("latin-1", "replace")
            elif m := re.fullmatch(r"([1-4]?)(u?)'([+-]?[0-9]+)", word):
                size = int(m[1] or 1)
                out += (int(m[3]) % (1 << 8 * size)).to_bytes(size, "little" if m[2] else "big")
            elif m := re.fullmatch(r"v([0-9]+)", word):
                out += smf.write_vlq(int(m[1]))
            elif m := re.fullmatch(r"t([0-9.]+)", word):
                out += round(6e7 / float(m[1])).to_bytes(3, "big")
            elif m := re.fullmatch(r"p([+-]?[0-9.]+)", word):
                value = max(0, min(16383, int((float(m[1]) + 1) * 8191.5 + 0.5)))
                out += bytes([value % 128, value // 128])
            elif re.fullmatch("[01]*,[01]*", word):
                left, right = word.split(",")
                out.append(int(left.rjust(4, "0")[-4:] + right.rjust(4, "0")[-4:] or "0", 2))
            elif re.fullmatch("[01]{8}", word):
                out.append(int(word, 2))
            elif re.fullmatch("[0-9a-fA-F]{1,2}", word):
                out.append(int(word, 16))
            else:
                raise ValueError(f"no bytes in {word!r}")
    return bytes(out)


def to_binasc(data: bytes, comments: bool = False) -> str:
    """A text that from_binasc turns back into the same bytes: header and track heads by field, a line per message."""
    try:
        # of a message only track, tick and status stay, as numbers
        tracks, ticks, kinds = array("H"), array("q"), bytearray()
        for r in smf.parse(data):
            tracks.append(r[1])
            ticks.append(r[3])
            kinds.append(r[4])
    except (ValueError, IndexError):
        return "\n".join(" ".join(f"{b:02x}" for b in data[i : i + 25]) for i in range(0, len(data), 25)) + "\n"
    note = lambda s: f"\t; {s}" if comments else ""
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    lines = [f'"MThd" 4\'{number(4, 4)} 2\'{number(8, 2)} 2\'{number(10, 2)} 2\'{number(12, 2)}{note("header")}']
    at, place = 14, 0
    for track in range(number(10, 2)):
        end = at + 8 + number(at + 4, 4)
        lines.append(f'"MTrk" 4\'{number(at + 4, 4)}{note(f"track {track}")}')
        at += 8
        while place < len(tracks) and tracks[place] == track:
            start, status = at, kinds[place]
            delta, at = smf.read_vlq(data, at)
            vlq = f"v{delta}" if smf.write_vlq(delta) == data[start:at] else " ".join(f"{b:02x}" for b in data[start:at])
            begin = at
            if data[at] >= 0x80:
                at += 1
            if status in (0xF0, 0xF7, 0xFF):
                size, at = smf.read_vlq(data, at + (status == 0xFF))
                at += size
            else:
                at += (1 if status & 0xF0 in (0xC0, 0xD0) else 2) if status < 0xF0 else {0xF1: 1, 0xF2: 2, 0xF3: 1}.get(status, 0)
            lines.append(f'{vlq} {" ".join(f"{b:02x}" for b in data[begin:at])}{note(f"tick {ticks[place]}")}')
            place += 1
        if at < end:
            lines.append(" ".join(f"{b:02x}" for b in data[at:end]))
        at = end
    if at < len(data):
        lines.append(" ".join(f"{b:02x}" for b in data[at:]))
    return "\n".join(lines) + "\n"


def _by_row(files: DataFrame, column: str, of, kind: str, out: str) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.schema.names)
            values = (x.as_py() for x in b.column(cols.index(column)))
            made = [None if x is None else of(x) for x in values]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string() if kind == "string" else pa.binary())], names=[*cols, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{fields}, {out} {kind}")


def binasc_dump(files: DataFrame, column: str = "content", comments: bool = False) -> DataFrame:
    """files with ``binasc``, their bytes as a text."""
    return _by_row(files, column, lambda x: to_binasc(bytes(x), comments), "string", "binasc")


def binasc_content(files: DataFrame, column: str = "binasc") -> DataFrame:
    """files with ``content``, the bytes that a text describes."""
    return _by_row(files, column, from_binasc, "binary", "content")
