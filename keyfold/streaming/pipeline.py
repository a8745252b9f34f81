"""The stateful stream: a change log becomes table versions and a change feed.

Every micro-batch runs the batch operators against the current snapshot:

1. read the buckets the batch touches, tombstones included;
2. drop rows that are not newer than what their key has seen (replays, late rows);
3. write the accepted changes with both images to a folder of this attempt, which no
   reader looks into;
4. commit the advanced state of the touched buckets as the next version, whose manifest
   names the batch and the attempt;
5. move the attempt's folder into the feed.

So a change is in the feed only if it is committed, and once: an attempt that dies before
the commit leaves nothing visible, and one that dies behind it is finished by whoever
comes next, from the name in the manifest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from keyfold.operators.feed import images
from keyfold.operators.fold import (
    CREATED, LAST_SEQ, LIVE, UPDATED, advance, changed_between, is_late, records, with_prior,
)
from keyfold.plans.skew import GROUP_ROWS, find_slices
from keyfold.sources.log import LogSpec
from keyfold.sources.snapshot import Head, Snapshot, move, path_exists


def state_schema(log_schema: T.StructType, spec: LogSpec) -> T.StructType:
    """Columns of a state: key, system columns, fields."""
    at = log_schema[spec.ts].dataType
    return T.StructType(
        [T.StructField(k, log_schema[k].dataType) for k in spec.keys]
        + [
            T.StructField(LAST_SEQ, T.LongType()),
            T.StructField(LIVE, T.BooleanType()),
            T.StructField(CREATED, at),
            T.StructField(UPDATED, at),
        ]
        + [T.StructField(f, log_schema[f].dataType) for f in spec.fields]
    )


@dataclass(frozen=True)
class ChangePipeline:
    spark: SparkSession
    root: str
    spec: LogSpec
    log_schema: T.StructType
    buckets: int = 64
    group_rows: int = GROUP_ROWS
    #: fields that equality filters are expected on: bloom filters for all, the order in a bucket by the first
    indexed: tuple[str, ...] = ()

    @property
    def snapshot(self) -> Snapshot:
        return Snapshot(
            self.spark,
            f"{self.root}/state",
            state_schema(self.log_schema, self.spec),
            self.spec.keys,
            self.buckets,
            self.indexed,
        )

    @property
    def feed_path(self) -> str:
        return f"{self.root}/feed"

    def process(self, batch: DataFrame, batch_id: int, rows: int | None = None) -> None:
        """Apply one micro-batch; safe to call again with the same id.

        A caller who knows the number of ``rows`` saves the search for hot keys where there can't be any.
        """
        store = self.snapshot
        head = store.head()
        self._deliver(head)
        if head is not None and head.batch_id >= batch_id:
            return
        log = batch.select(*self.spec.columns)
        buckets = store.touched(log, head)
        if not buckets:
            return
        state = store.read(buckets=buckets, head=head)
        few = rows is not None and rows <= self.group_rows
        slices = None if few else find_slices(log, self.spec.keys, self.spec.seq, self.group_rows)
        # one join with the state serves all three results; lost blocks are computed again
        judged = with_prior(log, state, self.spec, slices).withColumn("late", is_late(self.spec)).persist()
        fresh = judged.filter("not late")
        attempt = uuid.uuid4().hex
        images(fresh, self.spec, slices=slices).write.parquet(self._waiting(batch_id, attempt))
        late = judged.filter("late").select(*self.spec.columns)
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{self.root}/late/batch={batch_id}")
        store.commit(advance(state, fresh, self.spec), buckets, batch_id, head=head, attempt=attempt)
        judged.unpersist()
        self._deliver_attempt(batch_id, attempt)

    def _waiting(self, batch_id: int, attempt: str) -> str:
        return f"{self.root}/waiting/{batch_id}-{attempt}"

    def _deliver(self, head: Head | None) -> None:
        """Put the changes of the newest version into the feed, if they are not there yet."""
        if head is not None and head.attempt:
            self._deliver_attempt(head.batch_id, head.attempt)

    def _deliver_attempt(self, batch_id: int, attempt: str) -> None:
        waiting = self._waiting(batch_id, attempt)
        if path_exists(self.spark, waiting):
            move(self.spark, waiting, f"{self.feed_path}/batch={batch_id}")

    def start(
        self, stream: DataFrame, available_now: bool = False, every: str = "10 seconds"
    ) -> StreamingQuery:
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**trigger)
            .start()
        )

    def table(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The live records of a version, with their system columns.

        With ``keys`` only the buckets these keys fall into are read.
        """
        store = self.snapshot
        buckets = None if keys is None else store.touched(keys)
        return records(store.read(version, buckets), self.spec, system_fields=True)

    def changes_between(self, first: int, second: int) -> DataFrame:
        """What changed on balance from one version to another, see ``fold.changed_between``.

        Manifests say which buckets differ; only those are read, at both versions.
        """
        store = self.snapshot
        one, two = store.version(first), store.version(second)
        moved = [b for b in {*one.held, *two.held} if one.held.get(b) != two.held.get(b)]
        return changed_between(store.read(buckets=moved, head=one), store.read(buckets=moved, head=two), self.spec)

    def feed(self) -> DataFrame:
        return self.spark.read.parquet(self.feed_path)

    def late(self) -> DataFrame:
        """Rows that came too late, each with its ``batch``."""
        path = f"{self.root}/late"
        schema = T.StructType([*(self.log_schema[c] for c in self.spec.columns), T.StructField("batch", T.LongType())])
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)


def split_by_order(log: DataFrame, order: str, parts: int, path: str) -> None:
    """Write a log as ``parts`` consecutive folders ``part=<i>`` of equal order width."""
    span = log.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = -(-(span["hi"] - span["lo"] + 1) // parts)
    part = F.expr(f"({order} - {span['lo']}) div {width}").cast("int")
    log.withColumn("part", part).write.partitionBy("part").parquet(path)
