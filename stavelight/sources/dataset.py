"""Piece tables on disk, JSON pieces, and training batches.

A dataset is Parquet partitioned by split; random access is a filter on (split, row_id). Sequences are cropped and padded as array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segments import draw, pick

SPLITS = {0: "train", 1: "valid", 2: "test"}
EVENT = "struct<time:int,velocity:int,pitch:int>"
PIECE = (
    "resolution int, tempo int, tracks array<struct<instrument:int,trackType:string,bars:array<struct<events:array<int>,tsNumerator:int,tsDenominator:int,internalBeatLength:float>>>>, events array<struct<time:int,velocity:int,pitch:int>>"
)


#: Bytes of a row group: a look-up reads one. Ids of a file, by which its Bloom filter is sized.
ROW_GROUP, IDS_A_FILE = 8 << 20, 1_000_000


def append(pieces: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """Add rows (row_id, split 0/1/2, ...) to a dataset.

    Rows are dealt to files by ranges of row_id and sorted, so a file and a row group cover few ids each, and statistics exclude the others; Bloom filters exclude those that
    lie in range. The layout is what ``lookup`` relies on: nothing else is indexed.
    """
    m = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    options = {"compression": "zstd", "parquet.block.size": str(row_group), "parquet.bloom.filter.enabled#row_id": "true", "parquet.bloom.filter.expected.ndv#row_id": str(IDS_A_FILE)}
    df = pieces.withColumn("split", m[F.col("split")])
    df.repartitionByRange("split", "row_id").sortWithinPartitions("split", "row_id").write.mode("append").partitionBy("split").options(**options).parquet(path)


def read(spark: SparkSession, path: str, split: str, row_id: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df if row_id is None else df.where(F.col("row_id") == row_id)


def lookup(spark: SparkSession, path: str, split: str, row_ids: list[int]) -> DataFrame:
    """Rows of a short list of ids: one partition's files are listed, and of them the row groups whose statistics and Bloom filters admit an id are read."""
    return spark.read.parquet(path).where((F.col("split") == split) & F.col("row_id").isin(*row_ids))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("split").count()


def parse_pieces(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with ``piece``; legacy keys are understood and missing scalars get their defaults. Text that is no JSON gives a null piece."""
    text = F.col(column)
    for old, new in (("beatLength", "internalBeatLength"), ("type", "trackType"), ("features", "internalFeatures")):
        text = F.regexp_replace(text, f'"{old}"(\\s*:)', f'"{new}"$1')
    return rows.withColumn("piece", F.from_json(text, PIECE))


def piece_events(pieces: DataFrame, key: str = "piece_id") -> DataFrame:
    """(piece_id, track, bar, pos, time, velocity, pitch): the event numbers in bars followed into the piece's event list."""
    bars = pieces.select(F.col(key).alias("piece_id"), F.posexplode("piece.tracks").alias("track", "t"), F.col("piece.events").alias("all"))
    bars = bars.select("piece_id", "track", F.posexplode("t.bars").alias("bar", "b"), "all")
    rows = bars.select("piece_id", "track", "bar", F.posexplode("b.events").alias("pos", "i"), "all").withColumn("e", F.try_element_at("all", F.col("i") + 1))
    zero = lambda c: F.coalesce(f"e.{c}", F.lit(0)).alias(c)
    return rows.where("e is not null").select("piece_id", "track", "bar", "pos", zero("time"), zero("velocity"), zero("pitch"))


def piece_bars(pieces: DataFrame, key: str = "piece_id") -> DataFrame:
    bars = pieces.select(F.col(key).alias("piece_id"), F.posexplode("piece.tracks").alias("track", "t")).select("piece_id", "track", F.posexplode("t.bars").alias("bar", "b"))
    num, den = F.coalesce("b.tsNumerator", F.lit(4)), F.coalesce("b.tsDenominator", F.lit(4))
    return bars.select("piece_id", "track", "bar", num.alias("ts_num"), den.alias("ts_den"), (num / den * 4).cast("float").alias("beat_length"))


def to_pieces(tracks: DataFrame, bars: DataFrame, events: DataFrame, resolution: int = 12, tempo: int = 120) -> DataFrame:
    """(piece_id, json): the inverse of parse_pieces. bars: piece_id, track, bar, ts_num, ts_den; events: piece_id, track, bar, pos, time, velocity, pitch.

    Events are numbered once by piece and gathered once by bar and once by piece, so the work follows their number.
    """
    place = F.row_number().over(Window.partitionBy("piece_id").orderBy("track", "bar", "pos", "time", "velocity", "pitch")) - 1
    numbered = events.withColumn("_i", place)
    own = numbered.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("_i", "time", "velocity", "pitch"))).alias("es"))
    held = numbered.groupBy("piece_id", "track", "bar").agg(F.array_sort(F.collect_list("_i")).alias("events"))
    none = F.array().cast("array<int>")
    grid = bars.join(held, ["piece_id", "track", "bar"], "left").groupBy("piece_id", "track").agg(F.array_sort(F.collect_list(F.struct("bar", F.coalesce("events", none).alias("events"), "ts_num", "ts_den"))).alias("bs"))
    rows = tracks.join(grid, ["piece_id", "track"]).groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("track", "instrument", "track_type", "bs"))).alias("ts")).join(own, "piece_id", "left")
    bar = lambda t: F.transform(t["bs"], lambda b: F.struct(b["events"].alias("events"), b["ts_num"].alias("tsNumerator"), b["ts_den"].alias("tsDenominator"), (b["ts_num"] / b["ts_den"] * 4).cast("float").alias("internalBeatLength")))
    piece = F.struct(
        F.lit(resolution).alias("resolution"), F.lit(tempo).alias("tempo"), F.transform("ts", lambda t: F.struct(t["instrument"].alias("instrument"), t["track_type"].cast("string").alias("trackType"), bar(t).alias("bars"))).alias("tracks"),
        F.transform("es", lambda e: F.struct(e["time"].alias("time"), e["velocity"].alias("velocity"), e["pitch"].alias("pitch"))).alias("events"),
    )
    return rows.select("piece_id", F.to_json(piece).alias("json"))


def crop(tokens: Column, longest: int, seed: int, *keys: Column) -> Column:
    """A random run of at most ``longest`` tokens; the same keys give the same place, so that tokens and features stay aligned."""
    extra = F.greatest(F.size(tokens) - longest, F.lit(0))
    return F.slice(tokens, pick(extra + 1, seed, *keys) + 1, F.lit(longest))


def pad(tokens: Column, length: Column, with_: int = 0) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(with_), F.greatest(length - F.size(tokens), F.lit(0))))


def batches(sequences: DataFrame, batch_size: int, longest: int = 2048, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """(batch, tokens, mask): rows of batch_size sequences in random order, cropped and right-padded to the longest of their batch.

    A batch number is a hash bucket's running number, so no global sort is needed; a bucket's last batch may be smaller. There are as many buckets as
    partitions of a shuffle, unless told.
    """
    piece = F.col("piece_id")
    n = buckets or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = sequences.withColumn("tokens", crop(F.col("tokens"), longest, seed, F.col("piece_id"))).withColumns({"_h": draw(seed, piece), "_b": pick(F.lit(n), seed, piece)})
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "piece_id")) - 1
    df = df.withColumn("batch", F.concat_ws("-", F.col("_b").cast("string"), F.floor(place / batch_size).cast("string")))
    most = F.max(F.size("tokens")).over(Window.partitionBy("batch"))
    df = df.withColumns({"_most": most, "mask": F.transform("tokens", lambda _: F.lit(1))})
    return df.select("batch", "piece_id", pad(F.col("tokens"), F.col("_most")).alias("tokens"), pad(F.col("mask"), F.col("_most")).alias("mask"))
