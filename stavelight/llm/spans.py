"""Regular-expression matches with their code-point positions, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: the optimiser would copy it into lambdas otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def sums_before(xs: Column) -> Column:
    """Sum of the elements before each one, in blocks: near linear for long arrays too."""

    def of(a: Column) -> Column:
        ks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")))
        blocks = F.transform(ks, lambda k: total(F.slice(a, k * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))))
        return let(before, lambda b: F.transform(a, lambda _, i: F.element_at(b, F.floor(i / BLOCK).cast("int") + 1) + total(F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return let(xs, of)


def matches(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end, value); keep drops some by their text; gate is a cheap test that every text with a match passes.

    The text between matches and the matches themselves come from the same pattern, so their lengths add up to the positions.
    """

    def spans(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(m).cast("bigint") + F.length(F.element_at(gaps, i + 1)))
        out = let(sums_before(lengths), lambda b: F.transform(found, lambda m, i: let(
            F.element_at(b, i + 1) + F.length(F.element_at(gaps, i + 1)),
            lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")),
        )))
        return F.filter(out, lambda x: keep(x["value"])) if keep else out

    all_of = let(F.split(text, pattern, -1), lambda g: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: spans(g, m)))
    return F.when(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), all_of).otherwise(F.lit(None)).cast(SPAN)


def gathered(*parts: Column) -> Column:
    """All spans of several arrays; null arrays are empty."""
    return F.concat(*[F.coalesce(p, F.array().cast(SPAN)) for p in parts])


def in_order(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Sorted by kind as listed and start, or by start and kind."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    first = (lambda x: rank(x)) if by_kind else (lambda x: x["start"])
    then = (lambda x: x["start"]) if by_kind else (lambda x: rank(x))
    keyed = F.transform(spans, lambda x: F.struct(first(x).alias("a"), then(x).alias("b"), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
