"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / w, where u comes from a hash of its id and seed and w is its quality weight; in
key order the documents of a source are an Efraimidis-Spirakis sample of any length. A source takes whole epochs
first, then the shortest prefix of that order that fills its budget. The prefix sum is taken in two levels (slices of the key's
range, then inside a slice), so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Rows in a slice of the two-level prefix sum at least; slices of a source of n rows have about sqrt(n), so neither level outgrows a task.
SLICE_ROWS = 500
#: Quality weights: labelled good, unlabelled, labelled bad.
GOOD, UNKNOWN, BAD = 2.0, 1.0, 0.5


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return (F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) -> the same with target.

    Sources in code-point order, null last, weigh ``weights`` in turn. All words are shared by weight; what stands
    above ``most`` times a source's size goes to the others, until none is above. With sources by size / weight
    that is one running sum: the capped ones are a prefix of this order.
    """
    one = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = one.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))
    left = F.sum("w").over(one) - F.coalesce(F.sum("w").over(by), F.lit(0.0))
    df = df.withColumn("level", rest / left).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    # behind the first free source the running level only falls
    level = F.max(F.when(F.col("free"), F.col("level"))).over(one)
    return df.withColumn("target", F.when(F.col("free"), level * F.col("w")).otherwise(F.col("cap"))).drop("w", "cap", "level", "free")


def mix_sources(
    docs: DataFrame, quality: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 0, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, taken, and a digest of the text to tell rows apart (text_hash).

    quality: (doc_id, quality 0/1), both may be null or repeated (the largest counts). taken: words that the mix takes of the document,
    repeats counted: floor(target / source_size) whole epochs, then in order of (key, id, text hash) one more copy until the
    target, rounded to words, is met; the document on the boundary gives its first words only. Null texts and sources of no words have size
    and target 0; a null source is a source of its own, the last. Rows equal in id and text draw the same key and are taken one after the
    other. An empty table gives an empty one; other columns of docs are ignored.
    """
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"))
    q = F.lit(None).cast("int")
    if quality is not None:
        best = quality.where("doc_id is not null").groupBy(F.col("doc_id").alias("_qid")).agg(F.max("quality").alias("_q"))
        df = df.join(best, F.col("doc_id") == F.col("_qid"), "left").drop("_qid")
        q = F.col("_q")
    w = F.when(q > 0, GOOD).when(q == 0, BAD).otherwise(UNKNOWN)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    # a few numbers of each document, read three times below; the texts are read once
    df = cut(df.withColumn("key", -F.log(u) / w).select("doc_id", "source", "size", "text_hash", "key"))
    share = targets(df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most)
    df = df.join(share.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # slices of the key's range; those of a key that nothing but chance fills are about even
    n = F.ceil(F.col("n_docs") / F.greatest(F.lit(slice_rows), F.sqrt("n_docs")))
    df = df.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * n).cast("long"))
    sums = df.groupBy("source", "slice").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("slice").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
    df = df.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_k"))).drop("_s", "_k")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(inside)
    size, whole = F.col("source_size"), F.col("target")
    epochs = F.when(size > 0, F.least(F.floor(whole / size), F.lit(most))).otherwise(0).cast("long")
    budget = F.when(size > 0, F.round(whole).cast("long") - epochs * size).otherwise(F.lit(0).cast("long"))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - (upto - F.col("size"))))
    return df.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * epochs + extra).alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents that the mix takes, with size, target and taken: the training set's manifest."""
    docs = without(docs, ["size", "source_size", "target", "taken"])
    m = mix.select(F.col("doc_id").alias("_id"), "text_hash", "size", "source_size", "target", "taken")
    m = m.groupBy("_id", "text_hash").agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")])
    return docs.join(m, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("text_hash"))).drop("_id", "text_hash")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.doc_id, source, size,
        -ln((('0x' || substr(md5('0:' || d.doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
          / (CASE WHEN quality > 0 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END) AS key
      FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM t WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN cap > level * w THEN (max(CASE WHEN cap > level * w THEN level END) OVER ()) * w ELSE cap END::DOUBLE AS target FROM l),
r AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs,
        (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + greatest(0, least(size, CASE WHEN source_size > 0 THEN round(target)::BIGINT - epochs * source_size ELSE 0 END - (upto - size))))::BIGINT AS taken
FROM r
"""
