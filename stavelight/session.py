"""Sessions, and the code path of Python workers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's place of it, where workers see that folder too."""
    env, own = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in parts:
        env["PYTHONPATH"] = os.pathsep.join([own, *parts])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to a number of partitions that stays: for steps that make much of few bytes, which partitions sized by their bytes would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def local_session(cpus: int = 8, memory: str = "8g", name: str = "stavelight") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {"spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return share_code(builder.config(map=settings).getOrCreate())
