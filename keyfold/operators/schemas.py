"""Schemas as data: field lists from tables and records, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyfold.functions.rules import Rule, record_rules, violations, with_status
from keyfold.model import ARRAY, BOOLEAN, FIELD_STRUCT, FLOAT, INT, STRING, Field, TableSpec, fields_of
from keyfold.operators.write import Written, put


def infer_fields(df: DataFrame, indexed: Sequence[str] = (), sized_id: bool = True) -> DataFrame:
    """Field rows of a table: name, type, required, indexed, primary.

    Types come from the schema; a field is required when no record lacks it, which
    one counting pass over the whole table decides. An ``id`` is the String primary
    key; a table without one gets it, and both timestamps are appended.
    """
    columns = fields_of(df.schema, indexed)
    seen = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in columns]
    )

    def row(f: Field, required: Column) -> Column:
        primary = f.name == "id"
        return F.struct(
            F.lit(f.name).alias("name"),
            F.lit(STRING if primary else f.type).alias("type"),
            required.alias("required"),
            F.lit(f.indexed and not primary).alias("indexed"),
            F.lit(primary).alias("primary"),
        )

    names = {f.name for f in columns}
    rows = [row(f, F.col(f"`{f.name}`") == F.col("_n")) for f in columns]
    if sized_id and "id" not in names:
        rows.insert(0, row(Field("id"), F.lit(True)))
    rows += [row(Field(n), F.lit(True)) for n in ("createdAt", "updatedAt") if n not in names]
    return seen.select(F.inline(F.array(*rows)))


def infer_fields_untyped(records: DataFrame, column: str, indexed: Sequence[str] = ()) -> DataFrame:
    """Field rows of records without a schema, kept as JSON text or as variants.

    Every value tells its own type, and the types of a name are merged by one aggregation with map-side
    partials: Int and Float make Float, any other mixture String, and a name that has only nulls
    is a String. A field is required when no record lacks it or has null there; a record that is NULL, no JSON
    object or unreadable lacks all fields. ``id`` and both timestamps are as in :func:`infer_fields`.
    """
    value = F.col(column)
    if isinstance(records.schema[column].dataType, T.StringType):
        value = F.try_parse_json(value)
    named = records.select(
        F.explode(F.try_variant_get(value, "$", "map<string,variant>")).alias("name", "value")
    ).select("name", F.schema_of_variant("value").alias("kind"))
    given = named.filter(F.col("kind") != "VOID")
    kind = F.col("kind")
    integer, fraction = kind == "BIGINT", kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL)")
    merged = given.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(integer).alias("integers"),
        F.count_if(fraction).alias("fractions"),
        F.count_if(kind == "BOOLEAN").alias("booleans"),
        F.count_if(kind.startswith("ARRAY")).alias("arrays"),
    )
    empty = named.filter(kind == "VOID").select("name").distinct()
    merged = merged.join(empty, "name", "full")
    total = records.select(F.lit(1).alias("one")).agg(F.count("one")).scalar()
    all_of = F.col("n")
    logical = (
        F.when(F.col("name") == "id", STRING)
        .when(F.col("integers") == all_of, INT)
        .when(F.col("integers") + F.col("fractions") == all_of, FLOAT)
        .when(F.col("booleans") == all_of, BOOLEAN)
        .when(F.col("arrays") == all_of, ARRAY)
        .otherwise(STRING)
    )
    primary = F.col("name") == "id"
    found = merged.select(
        "name",
        logical.alias("type"),
        F.coalesce(F.col("n") == total, F.lit(False)).alias("required"),
        (F.col("name").isin(*indexed) & ~primary).alias("indexed"),
        primary.alias("primary"),
    )
    system = records.sparkSession.createDataFrame(
        [Field("id", STRING, True, False, True).as_row()]
        + [Field(n, STRING, True).as_row() for n in ("createdAt", "updatedAt")],
        FIELD_STRUCT,
    )
    return found.unionByName(system.join(found.select("name"), "name", "left_anti").select(*found.columns))


def parse_records(df: DataFrame, json_column: str, spec: TableSpec) -> DataFrame:
    """Records kept as JSON text, read with the StructType of the declared fields."""
    schema: T.StructType = spec.schema()
    return df.select(F.from_json(F.col(json_column), schema).alias("r")).select("r.*")


def check(
    df: DataFrame,
    key: Sequence[str],
    fields: Sequence[Field],
    partial: bool = False,
    present: dict[str, Column] | None = None,
    extra: Sequence[Rule] = (),
) -> DataFrame:
    """Every broken rule of every record."""
    return violations(df, key, [*record_rules(fields, partial, present), *extra])


def create_many(
    base: DataFrame, records: DataFrame, keys: Sequence[str], rules: Sequence[Rule], order: str | None = None
) -> Written:
    """Create a batch: good records are put, bad ones are rejected with their first error.

    One bad record does not stop the others. ``rejected`` has the records with
    ``ok``, ``error_field`` and ``error_rule``.
    """
    judged = with_status(records, rules)
    good = judged.filter("ok").select(*records.columns)
    written = put(base, good, keys, order)
    return Written(written.table, rejected=judged.filter("not ok"), new=written.new)


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Declared defaults for NULL fields; off unless a caller asks for it."""
    types = {c.name: c.dataType for c in df.schema.fields}
    return df.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v).cast(types[n])) for n, v in defaults.items()}
    )
