"""Every query with SQL gives the same rows in both engines; the others run."""

import duckdb
import pytest

from stavelight import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    def plain(v):
        return round(float(v), 5) if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in q.ORACLES:
        return
    want = con.sql(q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_transposition_counts_all_pitches(spark):
    pitches = {}
    for r in q.events(spark, SF).where("track % 5 <> 0").select("piece_id", "pitch").collect():
        pitches.setdefault(r.piece_id, []).append(r.pitch)
    got = {r.piece_id: r for r in q.QUERIES["transposed_pieces"](spark, SF).collect()}
    assert {k: (r.low, r.high) for k, r in got.items()} == {k: (min(p), max(p)) for k, p in pitches.items()}
    assert min(r.low for r in got.values()) < 20 and all(r.low + r.transpose >= 0 and r.high + r.transpose <= 127 for r in got.values())
