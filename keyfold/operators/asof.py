"""Records as they were: an as-of join of a log with many (key, position) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyfold.operators.feed import DETECT
from keyfold.plans.skew import GROUP_ROWS, Slices, find_slices, running_last
from keyfold.sources.log import CREATE, PUBLISH, LogSpec

_ORDER = "_order"


def _scanned(rows, asked, spec, values, group_rows, slices) -> DataFrame:
    """Log rows and questions in one order per key; a question comes behind the row at its place."""
    both = rows.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    if slices == DETECT:
        slices = find_slices(both, spec.keys, _ORDER, group_rows)
    return running_last(both, spec.keys, _ORDER, values, ("_asked",), slices).filter("_asked")


def records_as_of(
    log: DataFrame,
    requests: DataFrame,
    spec: LogSpec,
    group_rows: int = GROUP_ROWS,
    slices: Slices | None | str = DETECT,
) -> DataFrame:
    """The record each request's key had right after position ``spec.seq``; no row if it had none then.

    One sort per key of log and requests together; keys with very many rows are cut into pieces as for
    feeds. Repeated requests give one row.
    """
    stored = log.filter(F.col(spec.op) != PUBLISH).select(*spec.columns)
    rows = stored.withColumn(_ORDER, 2 * F.col(spec.seq))
    asked = requests.select(*spec.keys, F.col(spec.seq).cast("bigint").alias(spec.seq)).dropna().distinct()
    asked = asked.withColumn(_ORDER, 2 * F.col(spec.seq) + 1)
    values = {"reset": spec.reset(), **{f: spec.assignment(f) for f in spec.fields}}
    found = _scanned(rows, asked, spec, values, group_rows, slices).filter(F.col("before_reset") == CREATE)
    return found.select(*spec.keys, spec.seq, *[F.col(f"before_{f}.v").alias(f) for f in spec.fields])
