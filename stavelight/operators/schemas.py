"""Validation that a schema drives: ranges stand in the metadata of its fields, and the expressions that test them are made by walking it.

A nested piece is tested in place: arrays are walked by ``transform``, structs by field, and each value out of range becomes {path, value}. No row is exploded
before a violation is found, and nothing but the schema says what is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FloatType, IntegerType, StringType, StructField, StructType

FOUND = "array<struct<path:string,value:double>>"


def within(name: str, kind: DataType, least: float | None = None, most: float | None = None) -> StructField:
    """A field with its range."""
    return StructField(name, kind, metadata={k: v for k, v in (("min", least), ("max", most)) if v is not None})


# The fields of a piece and their ranges.
INT, HUGE = IntegerType(), 1_000_000
EVENT = StructType([within("time", INT, 0, HUGE), within("velocity", INT, 0, 127), within("pitch", INT, 0, 127), within("internalInstrument", INT), within("internalTrackType", INT), within("internalDuration", INT)])
BAR = StructType([within("events", ArrayType(INT), 0, 2_147_483_647), within("tsNumerator", INT, 1, HUGE), within("tsDenominator", INT, 1, HUGE), within("internalBeatLength", FloatType()), within("internalHasNotes", BooleanType())])
TRACK = StructType([within("bars", ArrayType(BAR)), within("instrument", INT, 0, 127), within("trackType", StringType())])
PIECE = StructType([within("tracks", ArrayType(TRACK)), within("events", ArrayType(EVENT)), within("resolution", INT, 1, 12), within("tempo", INT, 1, HUGE), within("internalSegmentLength", INT)])
# The fields of a generation request and of its parameters, and their ranges.
STATUS_TRACK = StructType([within("trackId", INT, 0, HUGE), within("polyphonyHardLimit", INT, 0, 100), within("temperature", FloatType(), 0.5, 2.0), within("selectedBars", ArrayType(BooleanType()))])
STATUS = StructType([within("tracks", ArrayType(STATUS_TRACK))])
PARAM = StructType([
    within("tracksPerStep", INT, 1, 12), within("barsPerStep", INT, 1, 8), within("modelDim", INT, 1, 8), within("percentage", INT, 1, 100), within("batchSize", INT, 1, 1), within("temperature", FloatType(), 0.5, 2.0), within("maxSteps", INT, 0, 2048),
])


def _tested(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _tested(kind.elementType)
    return isinstance(kind, StructType) and any(f.metadata.get("min") is not None or f.metadata.get("max") is not None or _tested(f.dataType) for f in kind.fields)


def _walk(value: Column, path: Column, kind: DataType, about: dict, present: DataType, skip: str, unset: float | None) -> list[Column]:
    """Arrays of violations in a value; present is the type that the table has there."""
    if isinstance(kind, ArrayType):
        if not (_tested(kind) or about.get("min") is not None or about.get("max") is not None):
            return []
        each = lambda x, i: _joined(_walk(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), kind.elementType, about, present.elementType, skip, unset))
        return [F.flatten(F.transform(value, each))]
    if isinstance(kind, StructType):
        out: list[Column] = []
        own = {f.name: f.dataType for f in present.fields}
        for f in kind.fields:
            if f.name not in own or f.name.startswith(skip):
                continue
            here = F.concat(path, F.lit(f".{f.name}"))
            out += [F.when(value.isNotNull(), x) for x in _walk(value[f.name], here, f.dataType, f.metadata, own[f.name], skip, unset)]
        return out
    least, most = about.get("min"), about.get("max")
    if least is None and most is None:
        return []
    number = value.cast("double") if unset is None else F.coalesce(value.cast("double"), F.lit(float(unset)))
    bad = F.lit(False) if least is None else number < least
    bad = bad if most is None else bad | (number > most) | F.isnan(number)
    return [F.when(bad, F.array(F.struct(path.alias("path"), number.alias("value"))))]


def _joined(parts: list[Column]) -> Column:
    """One array of the parts, of which null ones are empty."""
    none = F.array().cast(FOUND)
    return F.concat(*[F.coalesce(p.cast(FOUND), none) for p in parts]) if parts else none


def violations(df: DataFrame, column: str, schema: StructType, skip: str = "internal", unset: float | None = 0.0) -> Column:
    """[{path, value}] of the numbers in a nested column that are out of the range that the schema's metadata gives them; NaN is out of any.

    Fields whose names begin with ``skip`` aren't tested, nor those that the column doesn't have, or whose struct is null. A null number counts as ``unset``, as in
    formats that leave defaults out; None lets nulls pass. Paths are like ``piece.tracks[0].bars[2].tsNumerator``.
    """
    return _joined(_walk(F.col(column), F.lit(column), schema, {}, df.schema[column].dataType, skip, unset))


def out_of_range(df: DataFrame, column: str, schema: StructType, keys: list[str], skip: str = "internal", unset: float | None = 0.0) -> DataFrame:
    """(keys, path, value): a row for each violation."""
    return df.select(*keys, F.explode(violations(df, column, schema, skip, unset)).alias("_v")).select(*keys, "_v.path", "_v.value")
