"""Lenient conversion of record values to their declared logical type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyfold.model import ARRAY, BOOLEAN, FLOAT, INT, Field

# --- fixed values -----------------------------------------------------------
LEADING_INT = r"^\s*([+-]?[0-9]+)"
LEADING_FLOAT = r"^\s*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)"
# -----------------------------------------------------------------------------


def _leading(text: Column, pattern: str, dtype: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).try_cast(dtype)


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_text(col: Column, dtype: T.DataType) -> Column:
    """Text form; whole fractions lose the '.0', arrays are comma-joined."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        return F.when(whole, col.try_cast("bigint").cast("string")).otherwise(col.cast("string"))
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.transform(col, lambda x: to_text(x, dtype.elementType)), ",", "")
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def to_int(col: Column, dtype: T.DataType) -> Column:
    """Floor of a number, else the leading integer of its text; unreadable is NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        number = col.cast("double")
        return F.when(~F.isnan(number), F.floor(number))
    if _is_number(dtype):
        return col.cast("bigint")
    return _leading(to_text(col, dtype), LEADING_INT, "bigint")


def to_float(col: Column, dtype: T.DataType) -> Column:
    if _is_number(dtype):
        return col.cast("double")
    return _leading(to_text(col, dtype), LEADING_FLOAT, "double")


def to_bool(col: Column, dtype: T.DataType, strict: bool = False) -> Column:
    """Truthiness: any non-empty text is true, also 'false', unless ``strict``."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col, F.lit(False))
    if _is_number(dtype):
        number = col.cast("double")
        return F.coalesce((number != 0) & ~F.isnan(number), F.lit(False))
    if isinstance(dtype, T.StringType):
        truth = F.lower(F.trim(col)) == "true" if strict else col != ""
        return F.coalesce(truth, F.lit(False))
    return col.isNotNull()


def to_array(col: Column, dtype: T.DataType) -> Column:
    return col if isinstance(dtype, T.ArrayType) else F.array(col)


def coerce(col: Column, dtype: T.DataType, logical: str, strict: bool = False) -> Column:
    """Type names are matched exactly; any other name means text."""
    if logical == INT:
        return to_int(col, dtype)
    if logical == FLOAT:
        return to_float(col, dtype)
    if logical == BOOLEAN:
        return to_bool(col, dtype, strict)
    if logical == ARRAY:
        return to_array(col, dtype)
    return to_text(col, dtype)


def sanitize(
    df: DataFrame, fields: Sequence[Field], now: Column | None = None, strict: bool = False
) -> DataFrame:
    """Every column in its declared type, undeclared ones as text.

    ``createdAt`` is kept where set, ``updatedAt`` is always new; without ``now`` no
    timestamps are added.
    """
    logical = {f.name: f.type for f in fields}
    out = [
        coerce(F.col(c.name), c.dataType, logical.get(c.name, "String"), strict).alias(c.name)
        for c in df.schema.fields
    ]
    result = df.select(*out)
    if now is None:
        return result
    created = now
    if "createdAt" in df.columns:
        created = F.when(F.col("createdAt") != "", F.col("createdAt")).otherwise(now)
    return result.withColumns({"createdAt": created, "updatedAt": now})


def unreadable(df: DataFrame, key: Sequence[str], fields: Sequence[Field]) -> DataFrame:
    """Values that a number field could not take: key, field, rule, value."""
    types = {c.name: c.dataType for c in df.schema.fields}
    entries = []
    for f in fields:
        if f.type in (INT, FLOAT) and f.name in types:
            made = coerce(F.col(f.name), types[f.name], f.type)
            bad = F.col(f.name).isNotNull() & made.isNull()
            entry = F.struct(
                F.lit(f.name).alias("field"),
                F.lit("unreadable").alias("rule"),
                to_text(F.col(f.name), types[f.name]).alias("value"),
            )
            entries.append(F.when(bad, entry))
    found = F.array_compact(F.array(*entries))
    return df.select(*key, F.explode(found).alias("v")).select(*key, "v.field", "v.rule", "v.value")
