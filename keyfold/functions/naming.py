"""Tenant namespaces and derived names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
NAMESPACE_DIGITS = 8
NAME_MIN, NAME_MAX = 3, 50
NAME_PATTERN = "^[a-zA-Z][a-zA-Z0-9_]*$"
# -----------------------------------------------------------------------------


def namespace(key: Column, digits: int = NAMESPACE_DIGITS) -> Column:
    """First hex digits of the SHA-256 of a tenant key."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, digits)


def type_name(tenant: Column, table: Column) -> Column:
    return F.concat(F.lit("T"), tenant, F.lit("_"), table)


def capitalize(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**31 - 1))


def name_rule(name: Column) -> Column:
    """The rule a table name breaks, or NULL."""
    blank = name.isNull() | (name == "")
    return (
        F.when(blank, "non_empty")
        .when(~F.length(name).between(NAME_MIN, NAME_MAX), "length")
        .when(~name.rlike(NAME_PATTERN), "format")
    )


def namespace_collisions(
    keys: DataFrame, key: str, digits: int = NAMESPACE_DIGITS
) -> DataFrame:
    """Namespaces shared by several tenant keys.

    Keys are made distinct first, so a key that fills the table adds one row.
    """
    distinct = keys.select(F.col(key).cast("string").alias("k")).distinct()
    return (
        distinct.groupBy(namespace(F.col("k"), digits).alias("namespace"))
        .agg(F.count(F.lit(1)).alias("n_keys"))
        .filter(F.col("n_keys") > 1)
    )
