"""Shared helpers: checkpoints, column clashes and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

MASK = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, GRAM_BASE, GRAM_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes hashed at once by a Python worker; tables of powers grow to the next power of two.
CHUNK = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session where none is named, as in tests, gets a temporary one."""
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and released() deletes it once it isn't needed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def kept(table: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a written table that released() takes for the table."""
    view.folder = table.folder
    return view


def released(*tables: DataFrame) -> None:
    """Delete written tables."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the input columns an operator is about to produce itself, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(x: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(x) < n:
            x = np.concatenate([x, x * np.uint64(pow(base, len(x), 1 << 64))])
        return x

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = self._grow(self.up, self.base, n), self._grow(self.down, self.inverse, n)


_BYTES, _GRAMS, _GRAMS2 = Powers(BYTE_BASE), Powers(GRAM_BASE), Powers(GRAM_BASE_2)


def byte_table(is_word, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word byte?, hashed value) by byte; fold lower-cases A-Z."""
    word = np.array([bool(is_word(b)) for b in range(256)])
    value = np.array([(b + 32 if fold and 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)
    return word, value


#: Lower-cased runs of letters and digits, everything beyond ASCII counting as a letter.
ALNUM = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122, True)
#: Runs of anything but ASCII white space, unchanged.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13), False)


class Words:
    """Words of a chunk of documents: hash, byte span in the joined buffer, and first word of each document."""

    def __init__(self, blobs: list[bytes], table: tuple[np.ndarray, np.ndarray]):
        word, value = table
        self.data = b" ".join(blobs) + b" "
        a = np.frombuffer(self.data, np.uint8)
        w = word[a]
        edge = np.flatnonzero(w[1:] != w[:-1]) + 1
        if len(w) and w[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        _BYTES.need(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(value[a] * _BYTES.up[: len(a)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _BYTES.down[self.start] + (self.end - self.start).astype(np.uint64))
        self._total = total
        offsets = np.cumsum([0] + [len(b) + 1 for b in blobs])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(blobs)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self))

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word; 0 for words that are not longer."""
        s = np.minimum(self.start + n, len(self._total) - 1)
        h = mix((self._total[s] - self._total[self.start]) * _BYTES.down[self.start] + np.uint64(1_000_003 * n))
        return np.where(self.end - self.start > n, h, np.uint64(0))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def grams(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of the n items from each position; the last n - 1 positions are left out."""
    powers = _GRAMS2 if second else _GRAMS
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers.need(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers.up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * powers.down[: len(h) - n + 1] + np.uint64(n))


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of items [start, end) for many spans of one sequence."""
    powers = _GRAMS2 if second else _GRAMS
    powers.need(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers.up[: len(h)], out=total[1:])
    return mix((total[end] - total[start]) * powers.down[start] + (end - start).astype(np.uint64))


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def packed(x: bytes | None) -> bytes:
    """Size and zstd frame: texts cross the shuffle and the checkpoint at half their size or less."""
    x = x or b""
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unpacked(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)
