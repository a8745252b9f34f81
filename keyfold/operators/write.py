"""Set-at-a-time writes on keyed tables.

Every write takes the current records and a frame of changes and returns the next
records plus what was rejected or removed. Nothing is changed in place; see
``keyfold.sources.snapshot`` for committing a result as a table version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keyfold.operators.fold import advance, records, state_of
from keyfold.sources.log import CREATE, DELETE, LogSpec, rows_as_log


@dataclass(frozen=True)
class Written:
    """Next records, and the rows of the request that were refused or removed."""

    table: DataFrame
    rejected: DataFrame | None = None
    old: DataFrame | None = None
    new: DataFrame | None = None


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of every key.

    An aggregation, not a window: each task sends one row per key, however often a
    key repeats.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
        .select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns])
    )


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have; counted in every task before anything is sent."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def put(
    base: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None
) -> Written:
    """Create or replace whole records; with ``order`` the last row per key wins."""
    if order is not None:
        incoming = last_per_key(incoming, keys, order)
    incoming = incoming.select(*base.columns)
    kept = base.join(incoming.select(*keys), list(keys), "left_anti").select(*base.columns)
    return Written(kept.unionByName(incoming), new=incoming)


def put_if_absent(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> Written:
    """Insert records whose key is free; the others are rejected."""
    incoming = incoming.select(*base.columns)
    taken = base.select(*keys)
    fresh = incoming.join(taken, list(keys), "left_anti").select(*base.columns)
    refused = incoming.join(taken, list(keys), "left_semi").select(*base.columns)
    return Written(base.unionByName(fresh), rejected=refused, new=fresh)


def put_if(
    base: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    condition: Callable[[Column, Column], Column],
) -> Written:
    """Put under a condition on the stored and the new record, both structs.

    The stored one is NULL where the key is free. Keys of ``incoming`` are unique.
    """
    columns = base.columns
    stored = base.select(*keys, F.struct(*columns).alias("_old"))
    fresh = F.struct(*[F.col(c) for c in columns])
    judged = (
        incoming.select(*columns)
        .withColumn("_new", fresh)
        .join(stored, list(keys), "left")
        .withColumn("_ok", F.coalesce(condition(F.col("_old"), F.col("_new")), F.lit(False)))
    )
    good = judged.filter(F.col("_ok")).select(*columns)
    bad = judged.filter(~F.col("_ok")).select(*columns)
    return Written(put(base, good, keys).table, rejected=bad, new=good)


def update(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    present: Mapping[str, Column] | None = None,
    stamp: Mapping[str, Column] | None = None,
    immutable: Sequence[str] = ("createdAt",),
    order: str | None = None,
) -> Written:
    """Merge the given fields into existing records; absent keys are rejected.

    ``present`` says per field where a value was given (so NULL can be one); without
    it every column of ``updates`` counts as given. With ``order`` the last row of a key
    counts; without it, rows that share a key are rejected, as none of them is the right one.
    """
    present = present or {}
    given = [c for c in base.columns if c in updates.columns and c not in keys and c not in immutable]
    # one struct holds the change, under a name that no column of the table has
    change = _free("_change", base.columns)
    single = F.struct(
        *[F.col(c).alias(f"to_{i}") for i, c in enumerate(given)],
        *[present.get(c, F.lit(True)).alias(f"has_{i}") for i, c in enumerate(given)],
        F.lit(True).alias("hit"),
    )
    shaped = updates.select(*keys, single.alias(change), (F.col(order) if order else F.lit(0)).alias(_free("_at", [*keys, change])))
    at = shaped.columns[-1]
    grouped = shaped.groupBy(*keys).agg(
        F.max_by(change, at).alias(change), F.count(F.lit(1)).alias(at)
    )
    changes = (grouped if order else grouped.filter(F.col(at) == 1)).drop(at)
    hit = F.coalesce(F.col(change)["hit"], F.lit(False))
    merged = {
        c: F.when(F.col(change)[f"has_{i}"], F.col(change)[f"to_{i}"]).otherwise(F.col(c))
        for i, c in enumerate(given)
    }
    merged.update({n: F.when(hit, c).otherwise(F.col(n)) for n, c in (stamp or {}).items()})
    table = base.join(changes, list(keys), "left").select(
        *[merged[c].alias(c) if c in merged else F.col(c) for c in base.columns]
    )
    refused = updates.join(base.select(*keys), list(keys), "left_anti").select(*updates.columns)
    if not order:
        twice = updates.join(repeated(updates, keys), list(keys), "left_semi").select(*updates.columns)
        refused = refused.join(repeated(updates, keys), list(keys), "left_anti").select(*updates.columns)
        refused = refused.unionByName(twice)
    return Written(table, rejected=refused)


def _free(name: str, taken: Sequence[str]) -> str:
    """The name, with as many marks before it as no taken name has."""
    while name in taken:
        name = f"_{name}"
    return name


def update_expr(
    base: DataFrame,
    sets: Mapping[str, Column],
    condition: Column | None = None,
    using: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> Written:
    """Update by expressions over the record and, with ``using``, one row of arguments.

    Only records that meet the condition (and have arguments) change; ``new`` holds
    them as they are afterwards. A key with several rows of arguments has none.
    """
    joined = base
    hit = F.lit(True)
    if using is not None:
        rest = [c for c in using.columns if c not in keys]
        single = (
            using.groupBy(*keys)
            .agg(F.first(F.struct(F.lit(True).alias("_hit"), *rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
            .filter("_n = 1")
            .select(*keys, "_row.*")
        )
        joined = base.join(single, list(keys), "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    if condition is not None:
        hit = hit & F.coalesce(condition, F.lit(False))
    marked = joined.withColumn("_changed", hit).select(
        *[
            F.when(F.col("_changed"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
            for c in base.columns
        ],
        "_changed",
    )
    return Written(
        marked.drop("_changed"), new=marked.filter(F.col("_changed")).drop("_changed")
    )


def delete(base: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> Written:
    """Remove keys and return the removed records; unknown keys are no error."""
    gone = doomed.select(*keys).distinct()
    return Written(
        base.join(gone, list(keys), "left_anti").select(*base.columns),
        old=base.join(gone, list(keys), "left_semi").select(*base.columns),
    )


def batch_write(
    base: DataFrame, puts: DataFrame, deletes: DataFrame, keys: Sequence[str], order: str
) -> Written:
    """Puts and deletes as one request, applied per key in ``order``."""
    spec = LogSpec(tuple(keys), tuple(c for c in base.columns if c not in keys))
    log = rows_as_log(puts, spec, CREATE, F.col(order)).unionByName(
        rows_as_log(deletes, spec, DELETE, F.col(order))
    )
    state = advance(state_of(base, spec), log, spec)
    return Written(records(state, spec).select(*base.columns))


def with_system_fields(df: DataFrame, now: Column | None = None, id_column: Column | None = None) -> DataFrame:
    """Fill a missing ``id`` and stamp both timestamps, whatever the caller gave.

    Stamps are ISO-8601 UTC text at the edge. ``id`` defaults to a random UUID; give
    a column derived from the row where a rerun must produce the same ids.
    """
    fresh = F.expr("uuid()") if id_column is None else id_column
    at = iso_utc(F.current_timestamp() if now is None else now)
    if "id" in df.columns:
        given = F.col("id").cast("string")
        fresh = F.when(given.isNull() | (given == ""), fresh).otherwise(given)
    return df.withColumns({"id": fresh, "createdAt": at, "updatedAt": at})


def iso_utc(at: Column) -> Column:
    """ISO-8601 with milliseconds; the session time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
