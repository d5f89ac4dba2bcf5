"""Token-type grammars: which type may follow which. Graphs are a few dozen edges, made on the driver; sequences are checked by lead and join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocab import get_encoder, rows_of

_CONTROLS = "INSTRUMENT DENSITY_LEVEL MIN_POLYPHONY MAX_POLYPHONY MIN_NOTE_DURATION MAX_NOTE_DURATION BAR"
_FRAME = ["TRACK GENRE INSTRUMENT", _CONTROLS, "FILL_IN_PLACEHOLDER BAR_END", "BAR_END BAR", "BAR_END TRACK_END", "TRACK_END TRACK", "TRACK_END FILL_IN_START", "FILL_IN_END FILL_IN_START"]


def _after(sources: str, targets: str) -> list[str]:
    return [f"{a} {b}" for a in sources.split() for b in targets.split()]


# Paths of the three grammars; each is a chain of types that may follow one another.
PATHS = {
    "absolute": ["PIECE_START NUM_BARS TRACK", *_FRAME, "BAR TIME_SIGNATURE", *_after("TIME_SIGNATURE", "TIME_ABSOLUTE VELOCITY_LEVEL FILL_IN_PLACEHOLDER"), "VELOCITY_LEVEL NOTE_ONSET NOTE_DURATION",
                 *_after("NOTE_DURATION", "TIME_ABSOLUTE NOTE_ONSET VELOCITY_LEVEL BAR_END FILL_IN_END"), *_after("TIME_ABSOLUTE", "NOTE_ONSET VELOCITY_LEVEL BAR_END FILL_IN_END"), *_after("FILL_IN_START", "TIME_ABSOLUTE VELOCITY_LEVEL")],
    "duration": ["PIECE_START TRACK", *_FRAME, *_after("BAR", "TIME_DELTA VELOCITY_LEVEL FILL_IN_PLACEHOLDER"), "VELOCITY_LEVEL NOTE_ONSET NOTE_DURATION",
                 *_after("NOTE_DURATION", "TIME_DELTA NOTE_ONSET VELOCITY_LEVEL BAR_END FILL_IN_END"), *_after("TIME_DELTA", "TIME_DELTA NOTE_ONSET VELOCITY_LEVEL BAR_END FILL_IN_END"), *_after("FILL_IN_START", "FILL_IN_END TIME_DELTA VELOCITY_LEVEL")],
    "event": ["PIECE_START TRACK", *_FRAME, *_after("BAR", "TIME_DELTA NOTE_ONSET FILL_IN_PLACEHOLDER BAR_END"), *_after("NOTE_ONSET", "TIME_DELTA NOTE_ONSET BAR_END FILL_IN_END"),
              *_after("NOTE_OFFSET", "TIME_DELTA NOTE_ONSET NOTE_OFFSET BAR_END FILL_IN_END"), *_after("TIME_DELTA", "TIME_DELTA NOTE_ONSET NOTE_OFFSET BAR_END FILL_IN_END"), *_after("FILL_IN_START", "FILL_IN_END TIME_DELTA NOTE_ONSET")],
}


def edges(name: str, infill: bool = True) -> set[tuple[str, str]]:
    """Edges of an encoder's grammar. Types it lacks are bridged: what led to them leads to what followed them. Without infill its types go with their edges."""
    e = get_encoder(name)
    kind = "absolute" if e.config.use_absolute_time_encoding else "duration" if e.config.use_note_duration_encoding else "event"
    out = {(a, b) for path in PATHS[kind] for a, b in zip(path.split(), path.split()[1:], strict=False)}
    has = {k for k, _ in e.domains}
    for t in {x for p in out for x in p} - has:
        before, after = {a for a, b in out if b == t and a != t}, {b for a, b in out if a == t and b != t}
        out = {(a, b) for a, b in out if t not in (a, b)} | {(a, b) for a in before for b in after}
    if not infill:
        out = {(a, b) for a, b in out if not a.startswith("FILL_IN") and not b.startswith("FILL_IN")}
    return out


def edge_table(spark: SparkSession, name: str, infill: bool = True) -> DataFrame:
    return spark.createDataFrame(sorted(edges(name, infill)), "a string, b string")


def violations(tokens: DataFrame, allowed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adjacent tokens (keys, idx, a, b) whose types are no edge. tokens: keys, idx, token_type."""
    keys = keys or ["piece_id"]
    following = F.lead("token_type").over(Window.partitionBy(*keys).orderBy("idx"))
    pairs = tokens.select(*keys, "idx", F.col("token_type").alias("a"), following.alias("b")).where("b is not null")
    return pairs.join(F.broadcast(allowed), ["a", "b"], "left_anti").select(*keys, "idx", "a", "b")


def broken_edges(tokens: Column, name: str, infill: bool = True) -> Column:
    """How many adjacent tokens of an array are no edge, within its row; one outside the vocabulary has no edges."""
    own = {r[0]: r[1] for r in rows_of(get_encoder(name).domains) if r[6]}
    kinds = sorted(set(own.values()))
    n, told = len(kinds), edges(name, infill)
    kind = F.array(*[F.lit(kinds.index(own[t]) if t in own else n) for t in range(max(own) + 1)])
    edge = F.array(*[F.lit((a, b) in told) for a in [*kinds, None] for b in [*kinds, None]])
    types = F.transform(tokens, lambda t: F.coalesce(F.get(kind, t), F.lit(n)))
    # the last has nothing behind it
    pairs = F.zip_with(types, F.slice(types, F.lit(2), F.size(types)), lambda a, b: b.isNull() | F.get(edge, a * (n + 1) + b))
    return F.size(F.filter(pairs, lambda ok: ~ok))


def type_mask(name: str, last: str, infill: bool = True) -> list[str]:
    """Types that may follow ``last``."""
    return sorted(b for a, b in edges(name, infill) if a == last)


def dot(name: str, infill: bool = True) -> str:
    """The grammar as a DOT graph."""
    return "\n".join(["digraph {", *[f"  {a} -> {b};" for a, b in sorted(edges(name, infill))], "}"]) + "\n"
