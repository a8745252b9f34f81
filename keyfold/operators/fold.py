"""Folding a change log into table state.

A create fixes every field and a delete clears every field, so the last row that
fixes a field is never older than the last create or delete of its key. One
aggregation per key is enough: no join, no window, and partial aggregation on the
map side reduces a hot key to one row per task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keyfold.plans.skew import Slices, lookup
from keyfold.sources.log import CREATE, DELETE, PUBLISH, LogSpec

LAST_SEQ, LIVE, CREATED, UPDATED = "last_seq", "live", "created_at", "updated_at"
STATE = (LAST_SEQ, LIVE, CREATED, UPDATED)


def deltas(log: DataFrame, spec: LogSpec) -> DataFrame:
    """Per key, what a stretch of log does to whatever state came before it.

    ``reset`` is the last create or delete, ``set_<field>`` holds struct(v) if the
    field was fixed. Deltas of consecutive stretches compose (see :func:`advance`).
    """
    seq, op, ts = F.col(spec.seq), F.col(spec.op), F.col(spec.ts)

    def latest(value: Column, where: Column) -> Column:
        return F.max_by(F.when(where, value), F.when(where, seq))

    return (
        log.filter(op != PUBLISH)
        .groupBy(*spec.keys)
        .agg(
            F.max(seq).alias(LAST_SEQ),
            latest(op, spec.is_reset()).alias("reset"),
            latest(ts, op == CREATE).alias(CREATED),
            latest(ts, op != DELETE).alias(UPDATED),
            *[
                latest(F.struct(spec.value(f).alias("v")), spec.assigned(f)).alias(f"set_{f}")
                for f in spec.fields
            ],
        )
    )


def fold(log: DataFrame, spec: LogSpec) -> DataFrame:
    """State per key after a whole log, tombstones of deleted keys included."""
    return settle(deltas(log, spec), spec)


def settle(changed: DataFrame, spec: LogSpec) -> DataFrame:
    """State per key that deltas from the beginning of the log describe."""
    live = F.col("reset") == CREATE
    return changed.filter(F.col("reset").isNotNull()).select(
        *spec.keys,
        F.col(LAST_SEQ),
        live.alias(LIVE),
        F.when(live, F.col(CREATED)).alias(CREATED),
        F.when(live, F.col(UPDATED)).alias(UPDATED),
        *[F.when(live, F.col(f"set_{f}.v")).alias(f) for f in spec.fields],
    )


def placed_deltas(log: DataFrame, spec: LogSpec) -> DataFrame:
    """Deltas that know where in the order each of their parts comes from.

    Every part is struct(at, v). Such deltas compose in any order, and one that comes twice changes
    nothing (see :func:`combine`): a batch can be written once, replayed or late, and never touches another.
    """
    seq, op, ts = F.col(spec.seq), F.col(spec.op), F.col(spec.ts)

    def latest(value: Column, where: Column) -> Column:
        return F.max_by(F.when(where, F.struct(seq.alias("at"), value.alias("v"))), F.when(where, seq))

    return (
        log.filter(op != PUBLISH)
        .groupBy(*spec.keys)
        .agg(
            F.max(seq).alias(LAST_SEQ),
            latest(op, spec.is_reset()).alias("reset"),
            latest(ts, op == CREATE).alias(CREATED),
            latest(ts, op != DELETE).alias(UPDATED),
            *[latest(spec.value(f), spec.assigned(f)).alias(f"set_{f}") for f in spec.fields],
        )
    )


def combine(placed: DataFrame, spec: LogSpec) -> DataFrame:
    """Any number of placed deltas of a key as one; the later position wins each part.

    Associative, commutative and idempotent, one aggregation with partial results, so a key that is in every
    batch costs one row per task.
    """
    parts = ["reset", CREATED, UPDATED, *[f"set_{f}" for f in spec.fields]]
    return placed.groupBy(*spec.keys).agg(
        F.max(LAST_SEQ).alias(LAST_SEQ), *[F.max_by(p, F.col(p)["at"]).alias(p) for p in parts]
    )


def settle_placed(placed: DataFrame, spec: LogSpec) -> DataFrame:
    """State per key from placed deltas, equal to :func:`fold` of all their rows."""
    one = combine(placed, spec)
    return settle(
        one.select(
            *spec.keys,
            LAST_SEQ,
            F.col("reset.v").alias("reset"),
            F.col(f"{CREATED}.v").alias(CREATED),
            F.col(f"{UPDATED}.v").alias(UPDATED),
            *[F.col(f"set_{f}") for f in spec.fields],
        ),
        spec,
    )


def advance(state: DataFrame, log: DataFrame, spec: LogSpec) -> DataFrame:
    """State after one more stretch of log; equals folding both stretches at once.

    Both sides have one row per key, so the join has no hot group.
    """
    changed = deltas(log, spec).select(
        *spec.keys,
        F.col(LAST_SEQ).alias("d_seq"),
        F.col("reset").alias("d_reset"),
        F.col(CREATED).alias("d_created"),
        F.col(UPDATED).alias("d_updated"),
        *[f"set_{f}" for f in spec.fields],
    )
    was_live = F.coalesce(F.col(LIVE), F.lit(False))
    live = F.coalesce(F.col("d_reset") == CREATE, was_live)
    # without a reset the rows of a key that is not live are rejected updates
    applied = F.col("d_reset").isNotNull() | (was_live & F.col("d_seq").isNotNull())
    joined = state.join(changed, list(spec.keys), "full_outer")
    return joined.filter(F.col(LIVE).isNotNull() | F.col("d_reset").isNotNull()).select(
        *spec.keys,
        F.when(applied, F.greatest(F.col("d_seq"), F.col(LAST_SEQ)))
        .otherwise(F.col(LAST_SEQ))
        .alias(LAST_SEQ),
        live.alias(LIVE),
        F.when(live, F.coalesce(F.col("d_created"), F.col(CREATED))).alias(CREATED),
        F.when(live, F.when(applied, F.col("d_updated")).otherwise(F.col(UPDATED))).alias(UPDATED),
        *[
            F.when(
                live,
                F.when(applied & F.col(f"set_{f}").isNotNull(), F.col(f"set_{f}.v")).otherwise(
                    F.col(f)
                ),
            ).alias(f)
            for f in spec.fields
        ],
    )


def records(state: DataFrame, spec: LogSpec, system_fields: bool = False) -> DataFrame:
    """The live records of a state."""
    extra = [CREATED, UPDATED] if system_fields else []
    return state.filter(F.col(LIVE)).select(*spec.keys, *spec.fields, *extra)


def changed_between(before: DataFrame, after: DataFrame, spec: LogSpec) -> DataFrame:
    """What changed on balance from one state to a later one.

    Columns: key, kind, old_seq, new_seq, old struct, new struct. A record that came and went in between is not
    there, one that went and came again is a MODIFY. Positions tell what changed; values are never compared.
    """

    def side(state: DataFrame, name: str) -> DataFrame:
        return state.filter(F.col(LIVE)).select(
            *spec.keys, F.col(LAST_SEQ).alias(f"{name}_seq"), F.struct(*spec.fields).alias(name)
        )

    joined = side(before, "old").join(side(after, "new"), list(spec.keys), "full_outer")
    old, new = F.col("old_seq"), F.col("new_seq")
    kind = F.when(old.isNull(), "INSERT").when(new.isNull(), "REMOVE").otherwise("MODIFY")
    return joined.filter(~old.eqNullSafe(new)).select(
        *spec.keys, kind.alias("kind"), "old_seq", "new_seq", "old", "new"
    )


def state_of(table: DataFrame, spec: LogSpec, seq: int = -1) -> DataFrame:
    """A plain table of records as the state before any log row."""
    return table.select(
        *spec.keys,
        F.lit(seq).cast("bigint").alias(LAST_SEQ),
        F.lit(True).alias(LIVE),
        F.lit(None).cast("timestamp_ntz").alias(CREATED),
        F.lit(None).cast("timestamp_ntz").alias(UPDATED),
        *spec.fields,
    )


def with_prior(
    log: DataFrame, state: DataFrame, spec: LogSpec, slices: Slices | None = None
) -> DataFrame:
    """Log rows with what their key was before: ``_seen`` position, ``_was`` live, values."""
    prior = state.select(
        *spec.keys,
        F.col(LAST_SEQ).alias("_seen"),
        F.when(F.col(LIVE), CREATE).alias("_was"),
        *[F.struct(F.col(f).alias("v")).alias(f"_was_{f}") for f in spec.fields],
    )
    return lookup(log, prior, spec.keys, slices)


def is_late(spec: LogSpec) -> Column:
    """Whether a row of :func:`with_prior` is at or before what its key has seen."""
    return F.coalesce(F.col(spec.seq) <= F.col("_seen"), F.lit(False))
