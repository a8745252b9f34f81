"""Table definitions of many tenants as one DataFrame.

Columns: tenant, table_name, table_id, fields, subscriptions, description,
type_name, created_at, updated_at. Definitions stay one row per table; everything
about their fields is done on the arrays, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keyfold.functions.naming import name_rule, type_name
from keyfold.model import (
    EVENTS, FIELD_STRUCT, LOGICAL_TYPES, OPERATORS, STRING, SUBSCRIPTION_STRUCT, SYSTEM_FIELDS,
)

KEY = ["tenant", "table_name"]
COLUMNS = [
    *KEY, "table_id", "fields", "subscriptions", "description", "type_name", "created_at", "updated_at",
]
SCHEMA = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("table_id", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD_STRUCT)),
        T.StructField("subscriptions", T.ArrayType(SUBSCRIPTION_STRUCT)),
        T.StructField("description", T.StringType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)


def with_field_defaults(fields: Column) -> Column:
    """Left-out attributes of every field take their defaults."""
    return F.transform(
        fields,
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f["type"] != "", f["type"]).otherwise(STRING).alias("type"),
            *[
                F.coalesce(f[flag], F.lit(False)).alias(flag)
                for flag in ("required", "indexed", "primary")
            ],
        ),
    )


def no_subscriptions() -> Column:
    return F.array().cast(T.ArrayType(SUBSCRIPTION_STRUCT))


def items(definitions: DataFrame, now: Column, table_id: Column | None = None) -> DataFrame:
    """Definitions as registry rows: defaults filled, names derived, both stamps set."""
    return definitions.select(
        *KEY,
        (F.expr("uuid()") if table_id is None else table_id).alias("table_id"),
        with_field_defaults(F.col("fields")).alias("fields"),
        F.coalesce(F.col("subscriptions"), no_subscriptions()).alias("subscriptions"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        type_name(F.col("tenant"), F.col("table_name")).alias("type_name"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def definition_error(name: Column, fields: Column) -> Column:
    """Why a request is refused before any work starts, or NULL."""
    return F.when(name.isNull() | (name == "") | fields.isNull(), "missing").when(
        F.size(fields) == 0, "no_fields"
    )


def register(
    registry: DataFrame,
    definitions: DataFrame,
    idempotent: bool = False,
    ordinal: str = "ordinal",
    fail_fast: bool = False,
) -> DataFrame:
    """One status row per definition: tenant, table_name, ordinal, status, error.

    ``created`` for the first definition of a free name, ``failed`` otherwise; with
    ``idempotent`` a name that exists counts as ``exists`` and stays as it is. With
    ``fail_fast`` one definition without a name or fields refuses the whole batch.
    Names are reduced to their first ordinal by a hash aggregation, and rows meet
    their verdict on the unique ordinal, so a name repeated any number of times
    never gathers in one task.
    """
    error = definition_error(F.col("table_name"), F.col("fields"))
    if fail_fast:
        broken = definitions.select(error.alias("e")).agg(F.count("e")).scalar()
        error = F.coalesce(error, F.when(broken > 0, "batch_refused"))
    judged = definitions.select(*KEY, ordinal, error.alias("_error"))
    firsts = (
        judged.filter(F.col("_error").isNull())
        .groupBy(*KEY)
        .agg(F.min(ordinal).alias(ordinal))
        .join(registry.select(*KEY, F.lit(True).alias("_taken")), KEY, "left")
        .select(ordinal, F.coalesce("_taken", F.lit(False)).alias("_taken"), F.lit(True).alias("_first"))
    )
    # a later definition of a free name finds it taken by the first one
    created = F.col("_first") & ~F.col("_taken")
    present = "exists" if idempotent else "failed"
    status = (
        F.when(F.col("_error").isNotNull(), "failed").when(created, "created").otherwise(present)
    )
    return (
        judged.join(firsts, ordinal, "left")
        .select(
            *KEY,
            ordinal,
            status.alias("status"),
            F.when(status == "failed", F.coalesce("_error", F.lit("exists"))).alias("error"),
        )
    )


def registered(
    registry: DataFrame,
    definitions: DataFrame,
    statuses: DataFrame,
    now: Column,
    ordinal: str = "ordinal",
    table_id: Column | None = None,
) -> DataFrame:
    """The registry with the definitions whose status is ``created``."""
    created = statuses.filter(F.col("status") == "created").select(ordinal)
    fresh = definitions.join(created, ordinal, "left_semi")
    return registry.select(*COLUMNS).unionByName(items(fresh, now, table_id).select(*COLUMNS))


def batch_summary(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("tenant").agg(
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def list_tables(registry: DataFrame, tenant: str) -> DataFrame:
    return registry.filter(F.col("tenant") == tenant).orderBy("table_name")


def table_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_tables"))


def table_schema(registry: DataFrame) -> DataFrame:
    """Field dictionary: system fields a table does not declare, then its own fields."""
    declared = F.col("fields")

    def system(name: str) -> Column:
        primary = name == "id"
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(STRING).alias("type"),
            F.lit(True).alias("required"),
            F.lit(False).alias("indexed"),
            F.lit(primary).alias("primary"),
        )

    extra = F.filter(
        F.array(system("id"), system("createdAt"), system("updatedAt")),
        lambda s: ~F.array_contains(F.transform(declared, lambda f: f["name"]), s["name"]),
    )
    everything = F.concat(extra, with_field_defaults(declared))
    return registry.select(*KEY, F.inline(everything))


def primary_key(fields: Column) -> Column:
    """Name of the first field flagged primary, else of the first field."""
    flagged = F.filter(fields, lambda f: F.coalesce(f["primary"], F.lit(False)))
    return F.coalesce(F.get(flagged, F.lit(0))["name"], F.get(fields, F.lit(0))["name"])


def evolve(registry: DataFrame, updates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Replace fields, subscriptions or description where given; unknown tables are rejected.

    ``updates`` has one row per table. Data is not touched: readers use the new
    schema from then on.
    """
    changes = updates.select(
        *KEY,
        F.lit(True).alias("_hit"),
        with_field_defaults(F.col("fields")).alias("_fields"),
        F.col("subscriptions").alias("_subscriptions"),
        F.col("description").alias("_description"),
    )
    hit = F.col("_hit").isNotNull()
    changed = registry.join(changes, KEY, "left").select(
        *KEY,
        "table_id",
        F.coalesce("_fields", "fields").alias("fields"),
        F.coalesce("_subscriptions", "subscriptions").alias("subscriptions"),
        F.coalesce("_description", "description").alias("description"),
        F.when(hit, type_name(F.col("tenant"), F.col("table_name")))
        .otherwise(F.col("type_name"))
        .alias("type_name"),
        "created_at",
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    rejected = updates.join(registry.select(*KEY), KEY, "left_anti")
    return changed, rejected


def retire(registry: DataFrame, doomed: DataFrame) -> DataFrame:
    """The registry without the named tables, or without whole tenants; safe to repeat."""
    on = [c for c in KEY if c in doomed.columns]
    return registry.join(doomed.select(*on).distinct(), on, "left_anti").select(*COLUMNS)


def subscription_rows(registry: DataFrame) -> DataFrame:
    """One row per table, event kind and declared filter.

    Every table has the three channels; one without declarations gives rows with a
    NULL field.
    """
    event = F.explode(F.lit(list(EVENTS))).alias("event")
    per_subscription = registry.select(*KEY, "subscriptions", event).select(
        *KEY, "event", F.explode_outer("subscriptions").alias("s")
    )
    flat = per_subscription.select(*KEY, "event", F.explode_outer("s.filters").alias("f"))
    return flat.select(
        *KEY,
        "event",
        F.col("f.field").alias("field"),
        F.col("f.type").alias("type"),
        F.when(F.col("f").isNotNull(), F.coalesce("f.operator", F.lit("eq"))).alias("operator"),
        F.col("f.value").alias("value"),
    )


def broken_rules(fields: Column, names: Column | None = None) -> Column:
    """All broken rules of a field list as an array of (field, rule); ``names`` are the fields' if a column holds them."""
    names = F.transform(fields, lambda f: f["name"]) if names is None else names

    def entry(field: Column, rule: str) -> Column:
        return F.struct(field.cast("string").alias("field"), F.lit(rule).alias("rule"))

    def field_entry(f: Column, at: Column) -> Column:
        unnamed = f["name"].isNull() | (f["name"] == "")
        repeated = F.array_position(names, f["name"]) < at + 1
        unknown = ~F.coalesce(f["type"], F.lit("")).isin(*LOGICAL_TYPES)
        return (
            F.when(unnamed, entry(f["name"], "name"))
            .when(repeated, entry(f["name"], "duplicate"))
            .when(unknown, entry(f["name"], "type"))
        )

    # a nameless or repeated field is not looked at further, so not as a primary either
    usable = F.filter(
        F.transform(
            fields,
            lambda f, at: F.struct(
                F.coalesce(f["primary"], F.lit(False)).alias("primary"),
                (
                    (F.coalesce(f["name"], F.lit("")) != "")
                    & (F.array_position(names, f["name"]) == at + 1)
                ).alias("counts"),
            ),
        ),
        lambda s: s["primary"] & s["counts"],
    )
    empty = fields.isNull() | (F.size(fields) == 0)
    return F.when(empty, F.array(entry(F.lit(None), "no_fields"))).otherwise(
        F.concat(
            F.array_compact(F.transform(fields, field_entry)),
            F.when(F.size(usable) > 1, F.array(entry(F.lit(None), "primary"))).otherwise(
                F.array().cast("array<struct<field:string,rule:string>>")
            ),
        )
    )


def definition_violations(definitions: DataFrame) -> DataFrame:
    """Every broken definition rule: tenant, table_name, field, rule."""
    return definitions.select(*KEY, F.inline(broken_rules(F.col("fields"))))


def name_violations(definitions: DataFrame) -> DataFrame:
    rule = name_rule(F.col("table_name"))
    return definitions.select(*KEY, rule.alias("rule")).filter(F.col("rule").isNotNull())


# --- changes of definitions, and what is derived from them ----------------------

INSERT, MODIFY, REMOVE = "INSERT", "MODIFY", "REMOVE"


def _change_rows(definitions: DataFrame, kind: str) -> DataFrame:
    return definitions.select(*KEY, F.lit(kind).alias("kind"), "subscriptions")


def registered_changes(definitions: DataFrame, statuses: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The registry's feed of a registration: one INSERT per created table."""
    created = statuses.filter(F.col("status") == "created").select(ordinal)
    fresh = definitions.join(created, ordinal, "left_semi")
    return _change_rows(
        fresh.select(*KEY, F.coalesce("subscriptions", no_subscriptions()).alias("subscriptions")), INSERT
    )


def evolved_changes(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """One MODIFY per table whose declared subscriptions are given anew; other updates derive nothing."""
    given = updates.filter(F.col("subscriptions").isNotNull())
    return _change_rows(given.join(registry.select(*KEY), KEY, "left_semi"), MODIFY)


def retired_changes(registry: DataFrame, doomed: DataFrame) -> DataFrame:
    """One REMOVE per table that goes, also where whole tenants are named."""
    on = [c for c in KEY if c in doomed.columns]
    return _change_rows(registry.join(doomed.select(*on).distinct(), on, "left_semi"), REMOVE)


def maintained_subscriptions(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``subscription_rows`` of the registry behind ``changes``, from those before them.

    ``changes`` has at most one row per table. Only their keys meet the rows, and only their
    definitions are unfolded: nothing of the registry is read.
    """
    kept = rows.join(changes.filter(F.col("kind") != INSERT).select(*KEY), KEY, "left_anti")
    return kept.unionByName(subscription_rows(changes.filter(F.col("kind") != REMOVE)))


# --- declarations as text -------------------------------------------------------

DECLARATION = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD_STRUCT)),
        T.StructField("subscriptions", T.ArrayType(SUBSCRIPTION_STRUCT)),
        T.StructField("description", T.StringType()),
        T.StructField("_unreadable", T.StringType()),
    ]
)


def declarations(texts: DataFrame, text: str = "text", tenant: str = "tenant") -> DataFrame:
    """Table declarations kept as JSON text, with ``reason``: why one can't be used, or NULL.

    A declaration that is broken stops no other one. Reasons, the first that holds: ``tenant`` (none
    named), ``unreadable`` (no JSON object, cut off, or a value of the wrong shape), ``missing`` (no name, no
    list of fields), a rule of the fields (``no_fields``, ``name``, ``duplicate``, ``type``, ``primary``),
    ``filter`` (a filter on nothing, or on a field the table lacks) and ``operator``. NULL text is unreadable. Other
    columns of ``texts`` stay, unless they bear the name of a column of a definition.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}
    # JSON null, a list of no object and the like give a record without any value, not an error
    shown = F.ltrim(F.col(text)).startswith("{")
    parsed = F.from_json(F.col(text), DECLARATION, options)
    own = [c for c in texts.columns if c not in {tenant, text, *DECLARATION.names, "reason"}]
    rows = texts.select(
        F.col(tenant).alias("tenant"),
        *own,
        F.col(text).alias("text"),
        # as the output of a generator it is a column that every use reads; an alias would be parsed anew for each
        F.explode(F.array(F.when(shown, parsed))).alias("_d"),
    )
    # computed once as well: the rules look at all fields and names again for every field
    rows = rows.withColumn("_fields", F.explode(F.array(with_field_defaults(F.col("_d.fields")))))
    rows = rows.withColumn("_names", F.explode(F.array(F.transform("_fields", lambda f: f["name"]))))
    filters = F.flatten(
        F.transform(
            F.coalesce("_d.subscriptions", no_subscriptions()),
            lambda s: F.coalesce(s["filters"], F.array().cast(SUBSCRIPTION_STRUCT["filters"].dataType)),
        )
    )
    names = F.concat("_names", F.array(*[F.lit(n) for n in SYSTEM_FIELDS]))
    astray = F.exists(filters, lambda f: ~F.coalesce(F.array_contains(names, f["field"]), F.lit(False)))
    strange = F.exists(filters, lambda f: ~F.coalesce(f["operator"], F.lit("eq")).isin(*OPERATORS))
    reason = (
        F.when(F.coalesce("tenant", F.lit("")) == "", "tenant")
        .when(F.col("_d").isNull() | F.col("_d._unreadable").isNotNull(), "unreadable")
        .when(definition_error(F.col("_d.table_name"), F.col("_d.fields")) == "missing", "missing")
        .otherwise(
            F.coalesce(
                F.get(broken_rules(F.col("_fields"), F.col("_names")), F.lit(0))["rule"],
                F.when(astray, "filter"),
                F.when(strange, "operator"),
            )
        )
    )
    return rows.select(
        "tenant",
        F.col("_d.table_name").alias("table_name"),
        F.col("_d.fields").alias("fields"),
        F.col("_d.subscriptions").alias("subscriptions"),
        F.col("_d.description").alias("description"),
        *own,
        "text",
        F.explode(F.array(reason)).alias("reason"),
    )


def set_aside(declared: DataFrame, whole_tenant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable definitions, quarantine) of :func:`declarations`.

    With ``whole_tenant`` nothing of a tenant with a broken declaration is used; its sound ones go to the
    quarantine with the reason ``tenant_broken``. Tenants are reduced to their broken ones first, so a tenant
    with any number of tables gathers nowhere.
    """
    broken = F.col("reason").isNotNull()
    if whole_tenant:
        tenants = declared.filter(broken).select("tenant").distinct().withColumn("_broken", F.lit(True))
        marked = declared.join(tenants, "tenant", "left")
        held = F.when(F.col("_broken"), "tenant_broken")
        declared = marked.withColumn("reason", F.coalesce("reason", held)).drop("_broken")
    return declared.filter(~broken).drop("reason", "text"), declared.filter(broken)
