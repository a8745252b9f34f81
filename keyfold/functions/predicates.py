"""Filter predicates on typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal, InvalidOperation
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyfold.model import OPERATORS


def typed_literal(value: object, dtype: T.DataType) -> Column:
    """The value in the type of its column; text that does not fit it becomes NULL."""
    literal = F.lit(value)
    return literal.try_cast(dtype) if isinstance(value, str) else literal.cast(dtype)


def typed_equal(df: DataFrame, name: str, value: object) -> Column:
    return predicate(df, name, "eq", value)


_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _against_integer(column: Column, operator: str, value: object, dtype: T.DataType) -> Column | None:
    """A comparison of an integer column with any number, by exact integer bounds.

    ``>= 3.5`` is ``>= 4``; a bound that no value of the type reaches decides for all
    rows that have a value, and an equality that none can meet holds for none. None if the
    value is no number, or an integer of the type.
    """
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if isinstance(value, bool) or not number.is_finite():
        return None
    top = 2 ** _BITS[type(dtype)] - 1
    given, nothing = column.isNotNull(), F.lit(False) & column.isNotNull()
    if operator in ("eq", "ne"):
        if number != number.to_integral_value() or not -top - 1 <= number <= top:
            return nothing if operator == "eq" else given
        bound = int(number)
    elif operator in ("gt", "lte"):  # above, or not above, the integer below the number
        bound = floor(number)
        if bound > top:
            return nothing if operator == "gt" else given
        if bound < -top - 1:
            return given if operator == "gt" else nothing
    else:  # not below, or below, the integer above the number
        bound = ceil(number)
        if bound > top:
            return nothing if operator == "gte" else given
        if bound < -top - 1:
            return given if operator == "gte" else nothing
    return compare(column, operator, F.lit(bound).cast(dtype), dtype)


def compare(column: Column, operator: str, value: Column, dtype: T.DataType) -> Column:
    """One of the seven operators on a column and a literal of the column's type."""
    if operator == "contains":
        return F.array_contains(column, value) if isinstance(dtype, T.ArrayType) else F.contains(
            column.cast("string"), value.cast("string")
        )
    return {
        "eq": lambda: column == value,
        "ne": lambda: column != value,
        "gt": lambda: column > value,
        "lt": lambda: column < value,
        "gte": lambda: column >= value,
        "lte": lambda: column <= value,
    }[operator]()


def predicate(df: DataFrame, field: str, operator: str, value: object) -> Column:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}, expected one of {OPERATORS}")
    dtype = df.schema[field].dataType
    target = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype
    if operator == "contains" and not isinstance(dtype, T.ArrayType):
        target = T.StringType()
    if type(dtype) in _BITS and operator != "contains":
        exact = _against_integer(F.col(field), operator, value, dtype)
        if exact is not None:
            return exact
    return compare(F.col(field), operator, typed_literal(value, target), dtype)


def all_of(df: DataFrame, filters: Iterable[Mapping]) -> Column:
    """AND of filter declarations; one without a value constrains nothing."""
    parts = [
        predicate(df, f["field"], f.get("operator") or "eq", f["value"])
        for f in filters
        if f.get("value") is not None
    ]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
