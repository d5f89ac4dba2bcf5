"""Each stage on a small fixture, against the operators' brute-force versions."""

import random

import corpus_pipeline as cp
import pytest
from stavelight.llm import decontaminate as dc
from stavelight.llm import neardup as nd
from stavelight.llm.common import ALNUM, Words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    lines = ["shared one", "shared two", "shared three"]
    item = fresh(30)
    rows, labels = [], []
    for i in range(400):
        w = fresh(rng.randrange(30, 120))
        if i % 7 == 0:
            w[5:5] = ["vilefoe", "scum", "vilerat"]
        if i % 20 == 3:
            w[9:9] = item
        text = " ".join(w)
        if i % 11 == 1:
            text = "\n".join([*lines, text])
        if i % 13 == 12:
            text = rows[-1][1] if i % 2 else " ".join(rows[-1][1].split(" ")[:-1] + ["end"])
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, i % 2, int(i % 7 == 0)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), rows[5]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(cp.STAGES)
    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == cp.COLUMNS
    kept = {r.doc_id for r in clean.collect()}
    toxic = {i for i, t in before.items() if t and "scum" in t}
    assert not kept & toxic and len(set(before) - toxic - kept) <= 4
    lines = stage["line_dedup"](spark, docs, folder)
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == set(before)
    held = [i for i in sorted(before) if before[i] and "shared one\nshared two" in (after[i].text or "")]
    assert held == [min(i for i in before if before[i] and "shared one\nshared two" in before[i])]
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None and r.text != before[r.doc_id])
    one = stage["near_dedup"](spark, docs, folder).collect()
    ids = [r.doc_id for r in one]
    assert len(ids) == len(set(ids))
    words = {i: Words([(t or "").encode()], ALNUM).hash for i, t in before.items()}
    for i in set(before) - set(ids):
        assert any(j < i and (before[i] == before[j] or nd.similar(words[i], words[j])) for j in before)
    rows = stage["decontamination"](spark, docs, folder).collect()
    plain = dc.brute_force([(t or "").encode() for t in before.values()], [("1", " ".join(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").collect()).encode())])
    bad = {i for i, (n, h, _) in zip(before, plain, strict=True) if h and 20 * h >= n}
    assert {r.doc_id for r in rows} == set(before) - bad and bad
    mix = stage["mixing"](spark, docs, folder).collect()
    assert len(mix) == docs.count() and all(r.taken <= 3 * r.size for r in mix)


def test_stages_with_odd_rows(spark, folder):
    """Nulls in any column, repeated rows, a very long text, other columns with names that operators use: no crash, and the columns of documents."""
    long = " ".join(f"z{i}" for i in range(20_000))
    docs = spark.createDataFrame(
        [(None, None, None, None, None, 1.0, "a", 2), (5, "one two", None, "s", None, None, None, None), (5, "one two", None, "s", None, None, None, None), (6, long, "en", None, len(long), 0.5, "b", 1), (None, "free text", "en", "s", 9, None, "c", 3)],
        "doc_id long, text string, lang string, source string, n_chars long, score double, Label string, _md5 int",
    )
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        assert name == "mixing" or out.columns == cp.COLUMNS, name
        assert len(got) == (4 if name == "near_dedup" else 5) and {r.doc_id for r in got} == {None, 5, 6}, name
        assert name == "mixing" or any(r.text == long for r in got), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_run(spark, folder):
    out = cp.run(spark, folder)
    assert 200 < out.count() < 403 and {"doc_id", "taken"} <= set(out.columns)


def test_run_on_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
