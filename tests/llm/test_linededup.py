import random

from stavelight.llm import linededup as ld


def brute(rows):
    """(n_lines, n_removed, text) by row, windows compared as texts."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows if t is not None})
    import pyspark  # noqa: F401

    first: dict = {}
    gone: dict = {}
    for key in order:
        lines = key[2].split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" ") == "":
                continue
            if w in first:
                gone.setdefault(key, set()).update((p, p + 1, p + 2))
            else:
                first[w] = key
    out = []
    for d, t in rows:
        if t is None:
            out.append((0, 0, None))
            continue
        g = gone.get((d is not None, d or 0, t), set())
        lines = t.split("\n")
        out.append((len(lines), len(g), "\n".join(x for i, x in enumerate(lines) if i not in g)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    block = [["l1", "l2", "l3", "l4"], ["x", "", "y"], ["", " ", ""]]
    rows = [(None, "l1\nl2\nl3"), (1, None), (2, ""), (3, "a\nb"), (4, "r\n" * 3000)]
    for i in range(10, 80):
        parts = [rng.choice(block) if rng.random() < 0.5 else [f"u{rng.randrange(30)}" for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    rows.append(rows[-1])
    df = spark.createDataFrame([(d, t, 9, "k") for d, t in rows], "doc_id long, text string, n_lines int, _gone string").repartition(3)
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, str(r.text)) for r in ld.dedup_lines(df).collect())
    want = sorted((str(d), a, b, str(c)) for (d, _), (a, b, c) in zip(rows, brute(rows), strict=True))
    assert got == want and sum(x[2] for x in want) > 200


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
