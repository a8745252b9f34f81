"""A changing table as the deltas of its batches.

A micro-batch writes one delta per key it touches and nothing else: its cost does not depend on the
size of the table. The state is the combination of all deltas, made when it is read. Deltas
compose in any order and any number of times, so a batch that is replayed overwrites its own part or repeats what
is merged already, and a late row takes the place its position gives it.

:meth:`DeltaTable.merge` combines the newest parts while they are not small beside the one before them,
so there are only about log(batches) parts and every delta is written again that many times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from keyfold.operators.feed import images
from keyfold.operators.fold import combine, is_late, placed_deltas, records, settle_placed, with_prior
from keyfold.sources.log import LogSpec
from keyfold.sources.snapshot import path_exists, remove


@dataclass(frozen=True)
class Part:
    """The deltas of the batches ``first`` to ``last``."""

    first: int
    last: int
    path: str
    size: int


@dataclass(frozen=True)
class DeltaTable:
    spark: SparkSession
    root: str
    spec: LogSpec
    log_schema: T.StructType
    #: a part is merged with the newer ones unless it is more than this many times as large
    factor: int = 2

    def _schema(self) -> T.StructType:
        return placed_deltas(self.spark.createDataFrame([], self.log_schema), self.spec).schema

    def _path(self, first: int, last: int) -> str:
        return f"{self.root}/deltas/part-{first:019d}-{last:019d}"

    def _all(self) -> list[Part]:
        """All finished parts, those that a wider one covers included."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            path = status.getPath()
            name = path.getName().split("-")
            if name[0] == "part" and path_exists(self.spark, f"{path}/_SUCCESS"):
                found.append(Part(int(name[1]), int(name[2]), str(path), fs.getContentSummary(path).getLength()))
        return sorted(found, key=lambda p: (p.first, -p.last))

    def parts(self, before: int | None = None) -> list[Part]:
        """The parts that make up the table, or what it was before a batch."""
        out: list[Part] = []
        for part in self._all():
            if (before is None or part.last < before) and (not out or part.last > out[-1].last):
                out.append(part)
        return out

    def deltas(self, parts: list[Part] | None = None) -> DataFrame:
        parts = self.parts() if parts is None else parts
        schema = self._schema()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[p.path for p in parts])

    def state(self) -> DataFrame:
        return settle_placed(self.deltas(), self.spec)

    def table(self, system_fields: bool = True) -> DataFrame:
        return records(self.state(), self.spec, system_fields)

    def feed(self) -> DataFrame:
        """The changes of all batches, with both images."""
        return self.spark.read.parquet(f"{self.root}/feed").drop("batch")

    def append(self, batch: DataFrame, number: int, with_feed: bool = False) -> None:
        """Writes the deltas of batch ``number`` of the log, over those of an earlier attempt.

        With ``with_feed``, its changes go to the feed too, each once: they are those from the state that the
        batches before gave the touched keys, without rows that come late.
        """
        if any(p.first < number <= p.last or p.first <= number < p.last for p in self._all()):
            return  # finished and merged before
        if with_feed:
            keys = batch.select(*self.spec.keys).distinct()
            touched = self.deltas(self.parts(number)).join(keys, list(self.spec.keys), "left_semi")
            prior = with_prior(batch.select(*self.spec.columns), settle_placed(touched, self.spec), self.spec)
            changes = images(prior.filter(~is_late(self.spec)), self.spec)
            changes.write.mode("overwrite").parquet(f"{self.root}/feed/batch={number}")
        placed_deltas(batch, self.spec).write.mode("overwrite").parquet(self._path(number, number))

    def merge(self) -> Part | None:
        """Combines the newest parts; None if there is nothing to do.

        Parts that an earlier merge covered are removed first, so that readers have one merge's time to finish.
        """
        parts = self.parts()
        kept = {p.path for p in parts}
        for part in self._all():
            if part.path not in kept:
                remove(self.spark, part.path)
        chosen, size = [], 0
        for part in reversed(parts):
            if chosen and part.size > self.factor * size:
                break
            chosen.insert(0, part)
            size += part.size
        if len(chosen) < 2:
            return None
        path = self._path(chosen[0].first, chosen[-1].last)
        combine(self.deltas(chosen), self.spec).write.mode("overwrite").parquet(path)
        return next(p for p in self.parts() if p.path.endswith(path.rsplit("/", 1)[1]))

    def start(self, log: DataFrame, with_feed: bool = False, available_now: bool = False) -> StreamingQuery:
        """Appends a log stream batch by batch; merging is a job of its own."""
        writer = log.writeStream.foreachBatch(lambda rows, number: self.append(rows, number, with_feed))
        writer = writer.option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
