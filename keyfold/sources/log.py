"""The change-log contract.

A log row is ``key..., seq, ts, op, <field>..., present_<field>...``. ``seq`` is a
total order, ``op`` is create, update, delete or publish. ``present_<field>`` tells
an absent value from an explicit NULL; a create sets every field, absent ones to
NULL. Published rows are events only and never reach a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CREATE, UPDATE, DELETE, PUBLISH = "create", "update", "delete", "publish"


@dataclass(frozen=True)
class LogSpec:
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    seq: str = "seq"
    ts: str = "ts"
    op: str = "op"

    def present(self, field: str) -> Column:
        return F.col(f"present_{field}")

    @property
    def columns(self) -> list[str]:
        return [
            *self.keys,
            self.seq,
            self.ts,
            self.op,
            *self.fields,
            *[f"present_{f}" for f in self.fields],
        ]

    def is_reset(self) -> Column:
        """Rows after which nothing before them matters: create and delete."""
        return F.col(self.op).isin(CREATE, DELETE)

    def reset(self) -> Column:
        return F.when(self.is_reset(), F.col(self.op))

    def assigned(self, field: str) -> Column:
        """Whether the row fixes the field: given, or reset by a create or delete."""
        return self.is_reset() | self.present(field)

    def value(self, field: str) -> Column:
        """The value the row gives the field; NULL where it only resets it."""
        gives = self.present(field) & (F.col(self.op) != DELETE)
        return F.when(gives, F.col(field))

    def assignment(self, field: str) -> Column:
        """struct(value) where the row fixes the field, else NULL."""
        return F.when(self.assigned(field), F.struct(self.value(field).alias("v")))


def change_log(
    df: DataFrame,
    spec: LogSpec,
    keys: Mapping[str, Column],
    seq: Column,
    ts: Column,
    op: Column,
    fields: Mapping[str, Column],
    present: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Shape any source into a log; fields without a presence rule are always given."""
    present = present or {}
    return df.select(
        *[c.alias(n) for n, c in keys.items()],
        seq.cast("bigint").alias(spec.seq),
        ts.alias(spec.ts),
        op.alias(spec.op),
        *[fields[f].alias(f) for f in spec.fields],
        *[present.get(f, F.lit(True)).alias(f"present_{f}") for f in spec.fields],
    )


EVENT_LOG = LogSpec(keys=("id",), fields=("value", "props"))


def events_as_log(events: DataFrame) -> DataFrame:
    """The ``events`` table read as a change log of one record per user."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", CREATE).when(kind == "error", DELETE).otherwise(UPDATE)
    return change_log(
        events,
        EVENT_LOG,
        keys={"id": F.col("user_id")},
        seq=F.col("event_id"),
        ts=F.col("ts"),
        op=op,
        fields={"value": F.col("value"), "props": F.col("props")},
        present={
            "value": kind.isin("signup", "purchase"),
            "props": kind.isin("signup", "view"),
        },
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A change log kept as Parquet, read as a batch."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def rows_as_log(
    df: DataFrame, spec: LogSpec, op: str, seq: Column | None = None, ts: Column | None = None,
    given: Sequence[str] | None = None,
) -> DataFrame:
    """Plain records as log rows of one kind, e.g. a batch of puts or of deleted keys.

    Fields the frame lacks are NULL and absent.
    """
    given = [f for f in spec.fields if f in df.columns] if given is None else list(given)
    types = dict(df.dtypes)
    return df.select(
        *spec.keys,
        (F.lit(0) if seq is None else seq).cast("bigint").alias(spec.seq),
        (F.lit(None).cast("timestamp_ntz") if ts is None else ts).alias(spec.ts),
        F.lit(op).alias(spec.op),
        *[F.col(f) if f in types else F.lit(None).alias(f) for f in spec.fields],
        *[F.lit(f in given).alias(f"present_{f}") for f in spec.fields],
    )
