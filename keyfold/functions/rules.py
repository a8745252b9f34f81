"""Validation rules compiled to Columns.

A rule is true for a bad row. All rules of a table are evaluated in one pass over
the rows; no Python runs on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keyfold.model import ARRAY, BOOLEAN, FLOAT, INT, STRING, SYSTEM_FIELDS, Field, logical_type

# --- fixed values -----------------------------------------------------------
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
URL_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*://[^ ]+"
PHONE_MIN_LENGTH = 10
AGE_MIN, AGE_MAX = 0, 150
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    field: str
    name: str
    bad: Column
    value: Column

    def when(self, gate: Column) -> "Rule":
        return Rule(self.field, self.name, gate & self.bad, self.value)


# --- rules ------------------------------------------------------------------


def required(fields: Iterable[Field], blank: Mapping[str, Column] | None = None) -> list[Rule]:
    """Missing, NULL or empty required fields; system fields are exempt."""
    blank = blank or {}
    rules = []
    for f in fields:
        if f.required and f.name not in SYSTEM_FIELDS:
            col = F.col(f.name)
            bad = blank.get(f.name)
            if bad is None:
                bad = col.isNull()
                if logical_type(f.type) == STRING and (f.dtype is None or f.dtype.typeName() == "string"):
                    bad = bad | (col == "")
            rules.append(Rule(f.name, "required", bad, _text(col)))
    return rules


def shape(field: Field, column: Column | None = None) -> list[Rule]:
    """Rules that follow from a field's name and type; the first matching name wins."""
    col = F.col(field.name) if column is None else column
    name, kind = field.name, logical_type(field.type)
    found: list[tuple[str, Column]] = []
    if kind == STRING:
        if "email" in name:
            found.append(("email", ~col.rlike(EMAIL_PATTERN)))
        elif "url" in name:
            found.append(("url", ~col.rlike(URL_PATTERN)))
        elif "phone" in name:
            found.append(("min_len", F.length(col) < PHONE_MIN_LENGTH))
    elif kind == INT:
        if "age" in name:
            found.append(("range", ~col.between(AGE_MIN, AGE_MAX)))
        elif "count" in name or "quantity" in name:
            found.append(("non_negative", col < 0))
    elif kind == FLOAT:
        if "price" in name or "amount" in name:
            found.append(("non_negative", col < 0))
    return [Rule(name, rule, bad, _text(col)) for rule, bad in found]


def typed(fields: Iterable[Field]) -> list[Rule]:
    """Type rules for columns that already have a Spark type.

    Only what the type cannot rule out is left: a Float that is NaN, an Int column
    held as a fraction, and an Int beyond 32 bits, which is reported on its own.
    """
    rules = []
    for f in fields:
        col, kind = F.col(f.name), logical_type(f.type)
        stored = f.dtype.typeName() if f.dtype is not None else None
        if kind == FLOAT:
            rules.append(Rule(f.name, "type", F.isnan(col.cast("double")), _text(col)))
        elif kind == INT:
            if stored in ("double", "float", "decimal"):
                whole = col == F.floor(col.cast("double"))
                rules.append(Rule(f.name, "type", F.isnan(col.cast("double")) | ~whole, _text(col)))
            else:
                rules.append(
                    Rule(f.name, "int32_overflow", ~col.between(INT32_MIN, INT32_MAX), _text(col))
                )
    return rules


def json_typed(
    df: DataFrame, record: str, fields: Iterable[Field], skip: Sequence[str] = ()
) -> tuple[DataFrame, list[Rule]]:
    """Type rules for untyped records in a VARIANT column, with the frame to run them on.

    An absent field passes; an explicit null fails for every known type, and so does
    text that only looks like a number. ``5.0`` is an Int. Values and their kinds are
    projected once, before the rules.
    """
    checked = [f for f in fields if f.name not in skip and _known(f.type) is not None]
    items = {
        f"_item_{f.name}": F.try_variant_get(record, f"$['{f.name}']", "variant") for f in checked
    }
    kinds = {f"_kind_{f.name}": F.schema_of_variant(F.col(f"_item_{f.name}")) for f in checked}
    numbers = {
        f"_number_{f.name}": F.try_variant_get(f"_item_{f.name}", "$", "double")
        for f in checked
        if _known(f.type) == INT
    }
    rules = []
    for f in checked:
        item, kind = F.col(f"_item_{f.name}"), F.col(f"_kind_{f.name}")
        is_number = F.regexp_like(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        logical = _known(f.type)
        if logical == INT:
            number = F.col(f"_number_{f.name}")
            good = is_number & (number == F.floor(number))
        elif logical == FLOAT:
            good = is_number
        elif logical == ARRAY:
            good = kind.startswith("ARRAY")
        else:
            good = kind == logical.upper()
        bad = item.isNotNull() & ~F.coalesce(good, F.lit(False))
        rules.append(Rule(f.name, "type", bad, F.try_variant_get(item, "$", "string")))
    return df.withColumns(items).withColumns({**kinds, **numbers}), rules


def _known(name: str | None) -> str | None:
    """Logical type for checking values: names outside the table always pass."""
    lowered = (name or "").lower()
    if lowered in ("string",):
        return STRING
    kind = logical_type(lowered)
    return None if kind == STRING or lowered == "number" else kind


def record_rules(
    fields: Sequence[Field], partial: bool = False, present: Mapping[str, Column] | None = None
) -> list[Rule]:
    """All rules of a table in checking order: required, then type, then shape.

    Partial (update) checking looks only at fields marked present, and required
    fields may be left out or emptied.
    """
    declared = [f for f in fields if f.name not in SYSTEM_FIELDS]
    rules = ([] if partial else required(declared)) + typed(declared)
    for f in declared:
        rules += shape(f)
    if present is None:
        return rules
    return [r.when(present[r.field]) if r.field in present else r for r in rules]


# --- results ----------------------------------------------------------------


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per broken rule: key, field, rule, value."""
    broken = F.array_compact(F.array(*[_entry(r) for r in rules]))
    return df.select(*key, F.explode(broken).alias("v")).select(*key, "v.field", "v.rule", "v.value")


def first_error(rules: Sequence[Rule]) -> Column:
    """struct(field, rule, value) of the first broken rule in order, else NULL."""
    return F.coalesce(*[_entry(r) for r in rules], F.lit(None))


def with_status(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with ``ok``, ``error_field`` and ``error_rule``; no row is lost."""
    error = first_error(rules)
    return (
        df.withColumn("_error", error)
        .withColumn("ok", F.col("_error").isNull())
        .withColumn("error_field", F.col("_error.field"))
        .withColumn("error_rule", F.col("_error.rule"))
        .drop("_error")
    )


def _entry(rule: Rule) -> Column:
    entry = F.struct(
        F.lit(rule.field).alias("field"), F.lit(rule.name).alias("rule"), rule.value.alias("value")
    )
    return F.when(F.coalesce(rule.bad, F.lit(False)), entry)


def _text(col: Column) -> Column:
    return col.cast("string")
