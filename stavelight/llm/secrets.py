"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings. Built-in functions only.

A candidate is a long run of one character class. A window slides over it; the counts of its characters change by one in and
one out, and with them the sum of c * log2(c), held as fixed-point integers so that no rounding builds up. Windows whose entropy reaches
the class's threshold merge into spans. Candidates with an allow-listed part are suppressed, and spans inside a pattern's own match
are not told twice. Everything is row-local: no shuffle, one pass over the texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .spans import SPAN, gathered, in_order, let, listed, matches, of_kind

#: Fixed patterns, by kind.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = ["assign", "access", "hex"]
WINDOW = 20
SCALE = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of pattern that need all of ``needs``; threshold in bits a character."""

    kind: str
    alphabet: str
    fold: bool
    pattern: str
    threshold: float
    needs: tuple[str, ...]
    never: str = "^$"


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdef", True, r"[0-9A-Fa-f]{20,}", 3.0, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", False, r"[A-Za-z0-9+/_=-]{20,}", 3.8, ("[0-9]", "[A-Z]", "[a-z]"), "^[0-9A-Fa-f]+$"),
)
#: Parts of strings that are no secrets: placeholders and alphabets.
ALLOWED = ("EXAMPLE", "example", "xxxxxxxx", "XXXXXXXX", "00000000", "0123456789", "abcdefgh", "ABCDEFGH")
KINDS = [*BASE, *[c.kind for c in CLASSES]]


def terms(window: int) -> list[int]:
    """c * log2(c) in fixed point, for c from 0 to window."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def limit(window: int, threshold: float) -> int:
    """Entropy reaches the threshold as long as the sum of the terms is at most this."""
    return math.floor((math.log2(window) - threshold) * window * SCALE)


def dense_runs(value: Column, c: CharClass, window: int = WINDOW) -> Column:
    """Merged [s, e) of the windows of a candidate whose entropy reaches the threshold."""
    table, most, n = F.array(*map(F.lit, terms(window))), limit(window, c.threshold), len(c.alphabet)
    start = F.struct(
        F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("runs")
    )

    def step(codes: Column, old: Column, i: Column) -> Column:
        gone = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(0)
        come = F.element_at(codes, i)

        def moved(come: Column, gone: Column) -> Column:
            counts = F.transform(old["counts"], lambda x, k: x + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0))
            at = lambda k: F.element_at(old["counts"], k)
            up = F.element_at(table, at(come) + 2) - F.element_at(table, at(come) + 1)
            down = F.when(gone > 0, F.element_at(table, at(F.greatest(gone, F.lit(1)))) - F.element_at(table, at(F.greatest(gone, F.lit(1))) + 1)).otherwise(0)
            total = old["sum"] + F.when(come == gone, 0).otherwise(up + down)

            def merged(total: Column) -> Column:
                s, e, runs = (i - window).cast("bigint"), i.cast("bigint"), old["runs"]
                last = F.try_element_at(runs, F.lit(-1))
                grown = F.when(last["e"] >= s, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["s"].alias("s"), e.alias("e"))))).otherwise(
                    F.concat(runs, F.array(F.struct(s.alias("s"), e.alias("e"))))
                )
                return F.struct(counts.alias("counts"), total.alias("sum"), F.when((i >= window) & (total <= most), grown).otherwise(runs).alias("runs"))

            return let(total, merged)

        return let(come, lambda a: let(gone, lambda b: moved(a, b)))

    body = F.lower(value) if c.fold else value
    codes = F.transform(F.split(body, ""), lambda ch: F.instr(F.lit(c.alphabet), ch))
    return let(codes, lambda k: F.aggregate(F.sequence(F.lit(1), F.length(value)), start, lambda old, i: step(k, old, i), lambda end: end["runs"]))


def entropy_spans(text: Column, c: CharClass, allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW) -> Column:
    def candidate(v: Column) -> Column:
        ok = ~v.rlike(c.never)
        for p in c.needs:
            ok = ok & v.rlike(p)
        for a in allowed:
            ok = ok & ~v.contains(a)
        return ok

    def told(x: Column) -> Column:
        return F.transform(dense_runs(x["value"], c, window), lambda r: F.struct(
            F.lit(c.kind).alias("kind"), (x["start"] + r["s"]).alias("start"), (x["start"] + r["e"]).alias("end"), F.lit(None).cast("string").alias("value")
        ))

    return F.flatten(F.transform(matches(text, c.pattern, c.kind, candidate), told)).cast(SPAN)


def scan_secrets(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Docs with base_spans and spans: arrays of (kind, start, end, value), sorted by start, then kind.

    Positions count code points, end exclusive; value is null for spans that entropy adds. Base spans are what the fixed patterns find: assign
    (the whole match, its value of 8 characters or more), access (16 or more) and hex (32 or more). Null and empty texts have empty
    arrays. Row-local: repeated rows each get the same result, an empty table gives an empty one. Columns named base_spans or spans are replaced,
    others are carried.
    """
    docs = without(docs, ["base_spans", "spans"])
    t = F.col(text)
    base = gathered(
        matches(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8), matches(t, ACCESS, "access"), matches(t, HEX, "hex")
    )
    df = docs.withColumn("base_spans", in_order(base, KINDS, by_kind=False))
    more = gathered(*[entropy_spans(t, c, allowed) for c in classes])
    new = F.filter(more, lambda x: ~F.exists("base_spans", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return df.withColumn("spans", F.when(t.rlike(r"[A-Za-z0-9+/_=-]{20,}"), in_order(F.concat(F.col("base_spans"), new), KINDS, by_kind=False)).otherwise(F.col("base_spans")))


def digest(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", *[of_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all) spans of a text, in plain Python; for tests."""
    import re
    from collections import Counter

    text = text or ""
    keep = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    base = [(k, *m.span()) for k, p in (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")) for m in re.finditer(p, text) if keep[k](m)]
    spans = list(base)
    for c in CLASSES:
        for m in re.finditer(c.pattern, text):
            v = m[0]
            if re.search(c.never, v) or not all(re.search(p, v) for p in c.needs) or any(a in v for a in ALLOWED):
                continue
            runs: list[list[int]] = []
            for s in range(len(v) - WINDOW + 1):
                counts = Counter((v.lower() if c.fold else v)[s : s + WINDOW])
                if sum(terms(WINDOW)[n] for n in counts.values()) <= limit(WINDOW, c.threshold):
                    if runs and runs[-1][1] >= s:
                        runs[-1][1] = s + WINDOW
                    else:
                        runs.append([s, s + WINDOW])
            found = [(c.kind, m.start() + s, m.start() + e) for s, e in runs]
            spans += [x for x in found if not any(b[1] <= x[1] and x[2] <= b[2] for b in base)]
    order = lambda x: (x[1], KINDS.index(x[0]))
    return sorted(base, key=order), sorted(spans, key=order)


def _oracle() -> str:
    """The query's rows; window entropies are counted afresh for each window here."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    part = "SELECT doc_id, {k} AS kind, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m FROM d WHERE regexp_matches(t, {p})"
    rows = " UNION ALL ".join(part.format(k=q(k), p=q(p)) for k, p in [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *[(c.kind, c.pattern) for c in CLASSES]])
    ok = " OR ".join(
        f"(kind = {q(c.kind)} AND NOT regexp_matches(v, {q(c.never)})" + "".join(f" AND regexp_matches(v, {q(n)})" for n in c.needs) + "".join(f" AND NOT contains(v, {q(a)})" for a in ALLOWED) + ")"
        for c in CLASSES
    )
    fold = "CASE " + " ".join(f"WHEN kind = {q(c.kind)} THEN {'lower(v)' if c.fold else 'v'}" for c in CLASSES) + " END"
    most = "CASE " + " ".join(f"WHEN kind = {q(c.kind)} THEN {limit(WINDOW, c.threshold)}" for c in CLASSES) + " END"
    rank = f"list_position([{', '.join(map(q, KINDS))}], kind)"
    joined = f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, {rank})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({rows}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
a AS (SELECT doc_id, kind, m[i] AS v, (length(array_to_string(g[1 : i], '')) + length(array_to_string(m[1 : i - 1], '')))::BIGINT AS s FROM i),
b AS (SELECT doc_id, kind, s, s + length(v) AS e FROM a WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(regexp_extract(v, {q(ASSIGN)}, 2)) >= 8)),
w AS (SELECT doc_id, kind, s, {fold} AS v, unnest(range(0, length(v) - {WINDOW - 1})) AS o FROM a WHERE {ok}),
c AS (SELECT doc_id, kind, s, o, unnest(string_split(substr(v, (o + 1)::BIGINT, {WINDOW}), '')) AS ch FROM w),
n AS (SELECT doc_id, kind, s, o, ch, count(*) AS n FROM c GROUP BY ALL),
h AS (SELECT doc_id, kind, s + o AS p FROM n GROUP BY doc_id, kind, s, o HAVING sum({terms(WINDOW)}[n + 1]) <= {most}),
j AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, kind ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY p) AS run FROM j),
x AS (SELECT doc_id, kind, min(p) AS s, max(p) + {WINDOW} AS e FROM k GROUP BY doc_id, kind, run),
z AS (SELECT * FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)),
o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {joined} AS spans FROM b GROUP BY doc_id),
y AS (SELECT doc_id, {joined} AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(o.spans, '')) AS base_sha256, coalesce(y.spans, '') AS spans
FROM d LEFT JOIN o ON d.doc_id = o.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""


ORACLE = _oracle()
