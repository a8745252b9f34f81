"""Change feeds: which changes were accepted, and what they changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyfold.functions.predicates import typed_equal
from keyfold.operators.fold import LAST_SEQ, LIVE, with_prior
from keyfold.plans.skew import GROUP_ROWS, Slices, find_slices, running_last
from keyfold.sources.log import CREATE, DELETE, PUBLISH, UPDATE, LogSpec

#: look for hot keys; pass known slices, or None for none, to save the pass
DETECT = "detect"
INSERT, MODIFY, REMOVE = "INSERT", "MODIFY", "REMOVE"


def accepted(
    log: DataFrame,
    spec: LogSpec,
    state: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
    slices: Slices | None | str = DETECT,
) -> DataFrame:
    """Rows that changed something: creates, and updates and deletes of a live key.

    Only key, order and kind are read. ``state`` is the table before the log.
    """
    stored = log.filter(F.col(spec.op) != PUBLISH).select(*spec.keys, spec.seq, spec.op)
    if slices == DETECT:
        slices = find_slices(stored, spec.keys, spec.seq, group_rows)
    before = F.col("before_reset")
    if state is not None:
        stored = with_prior(stored, state.select(*spec.keys, LAST_SEQ, LIVE), LogSpec(spec.keys, ()), slices)
        before = F.coalesce(before, F.col("_was"))
    scanned = running_last(
        stored, spec.keys, spec.seq, {"reset": spec.reset()}, (spec.op,), slices
    )
    had = F.coalesce(before == CREATE, F.lit(False))
    return scanned.filter((F.col(spec.op) == CREATE) | had).select(*spec.keys, spec.seq, spec.op)


def images(
    log: DataFrame,
    spec: LogSpec,
    state: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
    slices: Slices | None | str = DETECT,
) -> DataFrame:
    """Accepted changes with their kind and the whole record before and after.

    Columns: key, seq, ts, op, kind, old struct, new struct. ``old`` is NULL for an
    INSERT and ``new`` for a REMOVE. ``state`` is the table before the log; a log that
    went through ``with_prior`` brings it along.
    """
    stored = log.filter(F.col(spec.op) != PUBLISH)
    if slices == DETECT:
        slices = find_slices(stored, spec.keys, spec.seq, group_rows)
    if state is not None:
        stored = with_prior(stored.select(*spec.columns), state, spec, slices)
    values: dict[str, Column] = {"reset": spec.reset()}
    values.update({f: spec.assignment(f) for f in spec.fields})
    before = {n: F.col(f"before_{n}") for n in values}
    after = {n: F.col(f"after_{n}") for n in values}
    if "_was" in stored.columns:
        prior = {"reset": F.col("_was"), **{f: F.col(f"_was_{f}") for f in spec.fields}}
        before = {n: F.coalesce(before[n], prior[n]) for n in values}
        after = {n: F.coalesce(after[n], prior[n]) for n in values}
        stored = stored.select(*spec.columns, "_was", *[f"_was_{f}" for f in spec.fields])
    else:
        stored = stored.select(*spec.columns)
    scanned = running_last(stored, spec.keys, spec.seq, values, (spec.op,), slices)
    op = F.col(spec.op)
    had = F.coalesce(before["reset"] == CREATE, F.lit(False))
    kind = F.when(op == DELETE, REMOVE).when(had, MODIFY).otherwise(INSERT)

    def record(side: Mapping[str, Column]) -> Column:
        return F.struct(*[side[f]["v"].alias(f) for f in spec.fields])

    return (
        scanned.withColumn("_had", had)
        .filter((op == CREATE) | F.col("_had"))
        .select(
            *spec.keys,
            spec.seq,
            spec.ts,
            spec.op,
            kind.alias("kind"),
            F.when(F.col("_had"), record(before)).alias("old"),
            F.when(op != DELETE, record(after)).alias("new"),
        )
    )


def payload(feed: DataFrame, spec: LogSpec) -> DataFrame:
    """What a subscriber receives: the full new record, or the deleted one."""
    seen = F.when(F.col(spec.op) == DELETE, F.col("old")).otherwise(F.col("new"))
    return feed.select(
        *spec.keys, spec.seq, spec.ts, spec.op, *[seen[f].alias(f) for f in spec.fields]
    )


def event_of(op: Column) -> Column:
    """The channel of an event: published events go to the update channel."""
    return F.when(op == PUBLISH, UPDATE).otherwise(op)


def subscribe(
    feed: DataFrame,
    event: str,
    filters: Mapping[str, object] | None = None,
    declared: Sequence[str] | None = None,
    event_column: str = "op",
    owner_column: str | None = None,
    listener: object | None = None,
) -> DataFrame:
    """One channel of a feed, batch or streaming, with AND-ed equality filters.

    A filter without a value constrains nothing, and where filter fields are declared
    others are ignored. With ``listener`` the listener's own events are left out.
    """
    chosen = feed.filter(event_of(F.col(event_column)) == event)
    for name, value in (filters or {}).items():
        if value is None or (declared is not None and name not in declared):
            continue
        chosen = chosen.filter(typed_equal(feed, name, value))
    if listener is not None:
        chosen = without_own(chosen, owner_column, listener)
    return chosen


def without_own(feed: DataFrame, owner_column: str, listener: object) -> DataFrame:
    """Events whose author is not the listener; events without an author stay."""
    return feed.filter(~F.coalesce(F.col(owner_column) == F.lit(listener), F.lit(False)))


def publish(events: DataFrame, spec: LogSpec, fields: Sequence[str]) -> DataFrame:
    """Events that are sent but not stored: the key, the order and the chosen fields."""
    carried = [c for c in (spec.seq, spec.ts) if c in events.columns]
    return events.select(*spec.keys, *carried, F.lit(PUBLISH).alias(spec.op), *fields)


def update_channel(updates: DataFrame, published: DataFrame, origin: str | None = None) -> DataFrame:
    """Stored updates together with published events; fields an event lacks are NULL."""
    if origin:
        updates = updates.withColumn(origin, F.lit("store"))
        published = published.withColumn(origin, F.lit("publish"))
    return updates.unionByName(published, allowMissingColumns=True)


def edit_history(feed: DataFrame, spec: LogSpec) -> DataFrame:
    """All edits of every record with the values before and after.

    ``feed`` is the result of :func:`images`. Rows are not renumbered: (key, seq)
    orders them, and numbering a hot key would need its rows in one place.
    """
    return feed.filter(F.col(spec.op) == UPDATE).select(
        *spec.keys, spec.seq, spec.ts, "old", "new"
    )
