"""A corpus pipeline of five stages over ``documents``: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of ``documents``, and other columns go.

Any column may be null. Rows with a null or empty text stay in every stage: they are clean, have no lines, are no one's copies and hold no benchmark words; the mix takes
no words of them. Null ids are rows like others; without a text they all stay. Repeated rows all stay but in near-dedup, which keeps one row of each class, ties of one id by the MD5 of
the text. Texts of any length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelight.llm import decontaminate, linededup, mixing, neardup, toxicity
from stavelight.llm.common import ensure_checkpoint_dir, released, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of three-line windows that occurred before; n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates."""
    docs = docs.select(COLUMNS)
    return neardup.keep_one(docs, neardup.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    out = decontaminate.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's manifest: every document with the words that the mix takes of it, repeats counted."""
    out = mixing.mix_sources(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Toxicity and near duplicates are no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and reread. A stage's table goes once the next one is written; the result reads the last."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            old, docs = before, written(docs, f"{folder}/{name}")
            before = docs
            if old is not None:
                released(old)
    return docs
