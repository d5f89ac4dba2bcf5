"""Notes of streams against notes of the whole table."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stavelight.operators import notes as N
from stavelight.streaming import notes as S

SCHEMA = "ts timestamp, piece_id int, track int, pitch int, tick int, velocity int, seq long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(tick, pitch, velocity, seq, track=0):
    return (START + timedelta(minutes=tick), 1, track, pitch, tick, velocity, seq)


def streamed(spark, tmp_path, parts, late, hang=None):
    """What a stream gives that reads a file a micro-batch; a last event, far later, moves the watermark past the others."""
    S.use_rocks(spark)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = [(START + timedelta(days=400 + i), -1, 0, 0, 0, 0, 0) for i in range(2)]
    for row in end:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.streamed_notes(rows, late, hang).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def plain(df):
    return sorted((r.piece_id, r.track, r.pitch, r.start, r.end, r.velocity) for r in df.collect())


def test_shuffled_batches_give_the_notes_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [event(rng.randrange(300), rng.randrange(60, 64), rng.choice([0, 0, 40, 90]), i, rng.randrange(2)) for i in range(400)]
    want = plain(N.pair_notes(spark.createDataFrame(rows, SCHEMA)))
    rng.shuffle(rows)
    got = streamed(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], "365 days")
    assert plain(got) == want and len(want) > 50 and got.where("hanging").count() == 0


def test_hanging_notes_and_late_events(spark, tmp_path):
    first = [event(0, 60, 50, 1), event(1, 61, 50, 2), event(30, 61, 0, 3), event(40, 62, 50, 4), event(45, 62, 60, 5), event(50, 62, 0, 6)]
    then = [event(300, 63, 50, 7), event(301, 63, 0, 8)]
    late = [event(2, 61, 0, 9), event(400, 60, 0, 10)]  # the first is behind the watermark; the second ends a note that is gone
    got = streamed(spark, tmp_path, [first, then, late], "1 minute", hang=2 * 3600 * 1000)
    assert sorted((r.pitch, r.start, r.end, r.velocity, r.hanging) for r in got.collect()) == [(60, 0, None, 50, True), (61, 1, 30, 50, False), (62, 45, 50, 60, False), (63, 300, 301, 50, False)]


def test_restart_goes_on_from_its_state(spark, tmp_path):
    S.use_rocks(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = S.streamed_notes(spark.readStream.schema(SCHEMA).parquet(source), "1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(out)
        q.awaitTermination()

    run([event(0, 60, 50, 1)])
    run([event(100, 61, 50, 2)])  # the onset at 0 is passed, so it is open state now
    run([event(110, 60, 0, 3), event(112, 61, 0, 4)])
    run([event(500, 90, 0, 5)])
    assert plain(spark.read.parquet(out)) == [(1, 0, 60, 0, 110, 50), (1, 0, 61, 100, 112, 50)]


@pytest.mark.parametrize("rows", [[], [event(0, 60, 50, 1)]])
def test_little_input(spark, tmp_path, rows):
    got = streamed(spark, tmp_path, [rows] if rows else [], "1 minute")
    assert got.where(F.col("piece_id") >= 0).count() == 0
