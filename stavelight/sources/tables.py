"""Plain tables: time-signature statistics, genre lists, density deciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def signature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(signature, num, den, n) of a CSV file whose first two columns are a quoted signature like 4/4 and its count."""
    df = spark.read.csv(path, header=False, quote='"', escape='"').select(F.regexp_replace("_c0", '[" ]', "").alias("signature"), F.col("_c1").try_cast("long").alias("n"))
    part = F.split("signature", "/")
    return df.where(F.col("n").isNotNull() & F.col("signature").rlike("^[0-9]+/[0-9]+$")).select("signature", part[0].cast("int").alias("num"), part[1].cast("int").alias("den"), "n")


def most_frequent(counts: DataFrame, k: int, column: str = "signature", n: str = "n") -> DataFrame:
    """(place, column, n): the k most frequent values; ties by value."""
    best = counts.groupBy(column).agg(F.sum(n).alias("n")).orderBy(F.desc("n"), column).limit(k)
    # at most k rows
    return best.select((F.row_number().over(Window.orderBy(F.desc("n"), column)) - 1).alias("place"), column, "n")


def genres(spark: SparkSession, path: str, column: str = "genre") -> DataFrame:
    """(number, genre): distinct genres of a tab-separated file with a header, without what follows ---, in order, NONE first."""
    df = spark.read.csv(path, sep="\t", header=True)
    names = df.select(F.trim(F.split(F.col(column), "---")[0]).alias("genre")).where("genre <> ''").distinct()
    # a taxonomy has tens of names
    number = F.row_number().over(Window.orderBy("genre"))
    return names.select(number.alias("number"), "genre").unionByName(spark.createDataFrame([(0, "NONE")], "number int, genre string"))


def density_deciles(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, quantiles) of JSON lines of density deciles: {"keys": ..., "quantiles": [...]}, one key for programs, two for the device's (track type, program)."""
    df = spark.read.schema(", ".join(f"{k} int" for k in keys) + ", quantiles array<int>").json(path)
    return df.where(F.size("quantiles") > 0)
