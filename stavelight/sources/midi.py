"""MIDI files as a Spark data source: ``spark.read.format("midi").load(path)`` and ``df.write.format("midi").save(path)``.

Register once a session with ``register``. Reading splits the listed files into partitions of about ``maxPartitionBytes``, 8 MB, some two million messages; a file that can't be read gives one row
with its error. Files that a pushed-down filter on ``piece_id`` (the path below the folder) excludes are not opened, tracks that one on ``smf_track`` excludes are
not built, and only the columns of the schema that the reader is given are filled, so ``.schema("piece_id string, tick long")`` is a narrow read. Writing
gives a file a piece, under a temporary folder, and moves all of them on commit; a job that fails leaves nothing.

Folders are what pyarrow's file systems open: local paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``. Executors and driver must see the same one.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import spread
from .smf import ROWS, SCHEMA, error_batch, file_batches, meta_message, serialise, write_vlq

FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    """Paths below the folder and sizes."""

    files: list[tuple[str, int]]


class MidiReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        unknown = set(schema.names) - set(FIELDS)
        if unknown:
            raise ValueError(f"a midi table has no {', '.join(sorted(unknown))}; it has {', '.join(FIELDS)}")
        self.names = schema.names
        self.path, self.glob = options["path"], options.get("pathGlobFilter", "*.mid")
        self.limit = int(options.get("maxPartitionBytes", 8 << 20))
        self.pieces: set[str] | None = None
        self.tracks: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute if isinstance(f, EqualTo | In) else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name == ("piece_id",):
                self.pieces = values if self.pieces is None else self.pieces & values
            elif name == ("smf_track",):
                self.tracks = values if self.tracks is None else self.tracks & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            found = [("", fs.get_file_info(root).size)]
        else:
            base = root.rstrip("/") + "/"
            inside = [(i.path.removeprefix(base), i.size) for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
            found = sorted(f for f in inside if fnmatch.fnmatch(f[0].rsplit("/", 1)[-1], self.glob) and not any(p.startswith(("_", ".")) for p in f[0].split("/")))
        found = [f for f in found if self.pieces is None or f[0] in self.pieces]
        parts: list[Files] = []
        total = self.limit + 1
        for name, size in found:
            if total + size > self.limit:
                parts.append(Files([]))
                total = 0
            parts[-1].files.append((name, size))
            total += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        columns: list[list[pa.Array]] = [[] for _ in self.names]
        rows = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=self.names)
            for c in columns:
                c.clear()
            return out

        for name, _ in partition.files:
            try:
                with fs.open_input_stream(f"{root.rstrip('/')}/{name}" if name else root) as f:
                    own = file_batches(name, f.read())
            except OSError as e:
                own = [error_batch(name, e)]
            for part in own:
                part = part if self.tracks is None else part.filter(pc.is_in(part.column("smf_track"), pa.array(sorted(t for t in self.tracks if t is not None), pa.int32())))
                for c, n in zip(columns, self.names, strict=True):
                    c.append(part.column(n))
                rows += part.num_rows
                if columns and rows >= ROWS:
                    yield batch()
                    rows = 0
        if columns and rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def message_bytes(status: int, p1: int | None, p2: int | None, meta_type: int | None, meta: bytes | None) -> bytes:
    """A message as it stands in a file, without its time."""
    if status == 0xFF:
        return meta_message(meta_type, bytes(meta or b""))
    if status in (0xF0, 0xF7):
        return bytes([status]) + write_vlq(len(meta or b"")) + bytes(meta or b"")
    if status >= 0xF0:
        return bytes([status])
    return bytes([status, p1]) + (b"" if status & 0xF0 in (0xC0, 0xD0) else bytes([p2 or 0]))


class MidiWriter(DataSourceArrowWriter):
    """Tables of (piece_id, content), bytes as they are, or of messages (piece_id, tpq, smf_track, tick, status, p1, p2, meta_type, meta), a piece's together and in order."""

    def __init__(self, schema: StructType, options, overwrite: bool):
        need = {"piece_id", "content"} if "content" in schema.names else {"piece_id", "tpq", "smf_track", "tick", "status", "p1", "p2", "meta_type", "meta"}
        if need - set(schema.names):
            raise ValueError(f"a midi sink needs the columns {', '.join(sorted(need - set(schema.names)))}")
        self.path, self.overwrite, self.raw = options["path"], overwrite, "content" in schema.names
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        names: dict[str, None] = {}

        def put(piece, data: bytes) -> None:
            name = str(piece)
            if not name or any(p in ("", "..") or p.startswith(("_", ".")) for p in name.split("/")):
                raise ValueError(f"{name!r} names no file")
            name = name if name.endswith(".mid") else f"{name}.mid"
            if name in names:
                raise ValueError(f"rows of {name} don't stand together")
            target = f"{root.rstrip('/')}/{self.job}/{name}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(target) as f:
                f.write(data)
            names[name] = None

        if self.raw:
            for b in batches:
                for piece, data in zip(b.column("piece_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                    put(piece, bytes(data or b""))
        else:
            rows = (r for b in batches for r in b.to_pylist())
            for piece, own in groupby(rows, key=lambda r: r["piece_id"]):
                tracks: list[list[tuple[int, bytes]]] = []
                tpq = None
                for r in own:
                    tpq = r["tpq"]
                    while len(tracks) <= r["smf_track"]:
                        tracks.append([])
                    tracks[r["smf_track"]].append((r["tick"], message_bytes(r["status"], r["p1"], r["p2"], r["meta_type"], r["meta"])))
                put(piece, serialise(tracks, tpq))
        return Written(list(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        root = root.rstrip("/")
        names = [n for m in messages if m for n in m.names]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            self.abort(messages)
            raise ValueError(f"two tasks wrote {twice[0]}: deal rows out by piece_id")
        there = [n for n in names if not self.overwrite and fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise ValueError(f"{there[0]} is there already")
        if self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if i.type == pafs.FileType.File and i.path.endswith(".mid") and f"/{self.job}/" not in i.path:
                    fs.delete_file(i.path)
        for n in names:
            if "/" in n:
                fs.create_dir(f"{root}/{n.rsplit('/', 1)[0]}", recursive=True)
            fs.move(f"{root}/{self.job}/{n}", f"{root}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        folder = f"{root.rstrip('/')}/{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class MidiDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return SCHEMA.replace(", ", ",")

    def reader(self, schema: StructType) -> MidiReader:
        return MidiReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MidiWriter:
        return MidiWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MidiDataSource)


def save(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Write messages, each piece's in one task and in order of seq; rows of files that had errors go."""
    register(messages.sparkSession)
    good = messages.where("error is null") if "error" in messages.columns else messages
    dealt = spread(good, "piece_id").sortWithinPartitions("piece_id", "smf_track", "seq")
    dealt.select(F.col("piece_id").cast("string").alias("piece_id"), "tpq", "smf_track", "tick", "status", "p1", "p2", "meta_type", "meta").write.format("midi").mode(mode).save(path)
