"""The MIDI data source: reads equal the decoder's, writes come whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stavelight.sources import midi, smf


def a_file(n: int) -> bytes:
    tracks = [[(0, smf.tempo_message(120)), (0, smf.signature_message(3, 4))], [(0, smf.message(0xC0, n)), (10 * n, smf.message(0x90, 60 + n, 64)), (10 * n + 480, smf.message(0x80, 60 + n, 0)), (5, bytes([0xF0, 2, 1, 0xF7]))]]
    return smf.serialise(tracks, 480)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(6):
        (tmp_path / "in" / ("deep" if i % 2 else "") / f"{i}.mid").write_bytes(a_file(i))
    (tmp_path / "in" / "bad.mid").write_bytes(b"MThd\x00\x00\x00\x06\x00\x01")
    (tmp_path / "in" / "empty.mid").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_text("no music")
    return tmp_path / "in"


def rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=str)


def test_reads_what_the_decoder_reads(spark, folder):
    midi.register(spark)
    df = spark.read.format("midi").load(str(folder))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mid").load(str(folder))
    want = smf.decode(files.withColumn("path", F.regexp_replace("path", f"^file:{folder}/", "")))
    # Spark's own source passes over files without bytes
    assert df.columns == want.columns and rows(df.where("piece_id <> 'empty.mid'")) == rows(want)
    assert {r.piece_id for r in df.where("error is not null").collect()} == {"bad.mid", "empty.mid"}
    assert spark.read.format("midi").load(f"file:{folder}/0.mid").count() == 8


def test_partitions_and_filters(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    reader = midi.MidiReader(StructType.fromDDL("piece_id string, tick long"), {"path": str(folder), "maxPartitionBytes": "200"})
    assert len(reader.partitions()) > 2 and sum(len(p.files) for p in reader.partitions()) == 8
    left = list(reader.pushFilters([EqualTo(("piece_id",), "deep/1.mid"), In(("smf_track",), (1, 2)), GreaterThan(("tick",), 3)]))
    assert left == [GreaterThan(("tick",), 3)] and [p.files[0][0] for p in reader.partitions()] == ["deep/1.mid"]
    midi.register(spark)
    df = spark.read.format("midi").schema("piece_id string, tick long").load(str(folder))
    assert df.columns == ["piece_id", "tick"] and df.where("piece_id = '2.mid'").count() == 8
    full = spark.read.format("midi").load(str(folder))
    assert full.where("smf_track = 0 and piece_id in ('0.mid', 'deep/1.mid')").count() == 6
    with pytest.raises(PySparkException, match="has no colour"):
        spark.read.format("midi").schema("piece_id string, colour int").load(str(folder)).collect()


def test_round_trip(spark, folder, tmp_path):
    midi.register(spark)
    read = lambda p: spark.read.format("midi").load(p)
    first = read(str(folder)).where("error is null")
    out = str(tmp_path / "out")
    midi.save(first, out)
    assert rows(read(out)) == rows(first) and not [d for d in os.listdir(out) if d.startswith("_")]
    with pytest.raises(PySparkException, match="there already"):
        midi.save(first.where("piece_id = '0.mid'").unionByName(first.where("piece_id = '2.mid'").withColumn("piece_id", F.lit("new"))), out)
    assert read(out).select("piece_id").distinct().count() == 6
    midi.save(first.where("piece_id = '2.mid'"), out, "overwrite")
    assert [r.piece_id for r in read(out).select("piece_id").distinct().collect()] == ["2.mid"]
    raw = spark.createDataFrame([("x", bytearray(a_file(3)))], "piece_id string, content binary")
    raw.write.format("midi").mode("append").save(out)
    assert {r.piece_id for r in read(out).select("piece_id").distinct().collect()} == {"2.mid", "x.mid"}


def test_a_failed_write_leaves_no_file(spark, folder, tmp_path):
    midi.register(spark)
    good = spark.read.format("midi").load(str(folder)).where("error is null")
    out = str(tmp_path / "out")
    cases = [
        good.withColumn("p1", F.when(F.col("piece_id") == "4.mid", 300).otherwise(F.col("p1"))),  # no byte: one task fails, others have written
        good.withColumn("piece_id", F.when(F.col("piece_id") == "4.mid", "../4.mid").otherwise(F.col("piece_id"))),
    ]
    for bad in cases:
        with pytest.raises(PySparkException):
            midi.save(bad, out, "append")
        assert not os.path.exists(out) or not [f for _, _, fs in os.walk(out) for f in fs]
    split = good.where("piece_id = '0.mid'").repartition(3)  # one piece in several tasks
    with pytest.raises(PySparkException, match="deal rows out by piece_id"):
        split.select("piece_id", "tpq", "smf_track", "tick", "status", "p1", "p2", "meta_type", "meta").write.format("midi").mode("append").save(out)
    assert not os.path.exists(out) or not [f for _, _, fs in os.walk(out) for f in fs]
