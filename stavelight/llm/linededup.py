"""Line dedup over overlapping three-line windows.

Every run of three consecutive lines is hashed (128 bits). Windows are grouped globally with map-side combining, so
a window that a third of all documents hold shrinks to one row per task before it is shuffled; groups of one drop out. Occurrences join
their group's first one: a sort-merge join whose hot keys AQE splits. Positions to remove meet per document and are merged there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

LINES = 3


def _windows(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(_id, _th, pos, h1, h2) of every window; windows of blank lines only don't count."""
    lines = F.split(F.col(text), "\n", -1)
    df = docs.select("_id", "_th", lines.alias("lines")).where(F.size("lines") >= n)

    def key(i: Column) -> Column:
        own = [F.element_at("lines", (i + j).cast("int")) for j in range(1, n + 1)]
        blank = F.trim(F.concat(*own)) == ""
        return F.when(~blank, F.struct(F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(7), *own[::-1]).alias("h2")))

    keys = F.transform(F.sequence(F.lit(0), F.size("lines") - n), key)
    df = df.select("_id", "_th", F.posexplode(keys).alias("pos", "k")).where("k is not null")
    return df.select("_id", "_th", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))


def repeated_windows(docs: DataFrame, text: str = "text", n: int = LINES) -> DataFrame:
    """(_id, _th, array of first lines) of the windows that occur earlier: at a smaller (id, text hash, line)."""
    rows = _windows(docs, text, n)
    at = F.struct("_id", "_th", "pos")
    first = rows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = rows.join(first, ["h1", "h2"]).where(at != F.col("first"))
    return later.groupBy("_id", "_th").agg(F.collect_set("pos").alias("_gone"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = LINES) -> DataFrame:
    """Docs with later occurrences of repeated windows cut out of the text, plus n_lines and n_removed (long).

    Lines are what newlines separate, compared exactly; a window is n consecutive lines of one document, and one of nothing but spaces
    doesn't count. Order is by (id, hash of the text, line), nulls first; a line goes if any window over it occurred before, in
    the same document too. Rows equal in id and text are one document and are treated alike. A null text stays null (no lines), an
    empty one has one line; documents of fewer than n lines stay as they are. A text may end up empty. An empty table gives
    an empty one. Columns of docs named n_lines or n_removed are replaced, others are carried.
    """
    docs = without(docs, ["n_lines", "n_removed", "_id", "_th", "_gone"])
    fields = docs.schema.fields
    keyed = docs.withColumns({"_id": F.col(doc_id), "_th": F.xxhash64(text)})
    gone = repeated_windows(keyed, text, n).withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    both = keyed.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left").withColumn("_raw", F.col(text).cast("binary"))
    names = [f.name for f in fields if f.name != text]
    both = both.select(*[f"`{c}`" for c in names], "_raw", "_gone")
    schema = T.StructType([*[f for f in fields if f.name != text], T.StructField("_out", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = both.mapInArrow(_cutter(names, n), schema)
    return done.select(*[(F.col("_out").cast("string").alias(text) if f.name == text else F.col(f"`{f.name}`")) for f in fields], "n_lines", "n_removed")


def _cutter(names: list[str], n: int):
    def run(batches):
        for b in batches:
            cols = b.schema.names
            texts, counts, removed = [], [], []
            for raw, gone in zip(b.column(cols.index("_raw")).to_pylist(), b.column(cols.index("_gone")).to_pylist(), strict=True):
                lines = [] if raw is None else raw.split(b"\n")
                if gone:
                    hit = np.zeros(len(lines), bool)
                    at = np.array(gone)
                    for d in range(n):
                        hit[at + d] = True
                    raw = b"\n".join(x for x, h in zip(lines, hit.tolist(), strict=True) if not h)
                    removed.append(int(hit.sum()))
                else:
                    removed.append(0)
                texts.append(raw)
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(cols.index(c)) for c in names], pa.array(texts, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                names=[*names, "_out", "n_lines", "n_removed"],
            )

    return run


#: The query's rows; windows are compared as texts here.
ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS k FROM p
      WHERE trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], ' ') <> ''),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS line FROM r WHERE n > 1),
l AS (SELECT doc_id, unnest(ls) AS body, unnest(range(0, len(ls))) AS line FROM d),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
        coalesce(string_agg(CASE WHEN g.line IS NULL THEN body END, chr(10) ORDER BY l.line), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
