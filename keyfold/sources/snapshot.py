"""Versioned table snapshots in Parquet.

Layout under a root folder::

    data/v=<n>/bucket=<b>/part-*.parquet    the buckets version n rewrote
    manifest/v=<n>/                         (bucket, version) rows, written last

Rows live in a bucket by the hash of their key, in one or more files. Choose the number
of buckets for the finished table, so that one holds about a gigabyte: a bucket is what a
commit rewrites (:func:`buckets_for`). A commit writes the touched buckets
into a new version folder and then a manifest that says, for every bucket, which
version holds it. A version exists once its manifest has its success marker, so a job that dies half
way leaves nothing visible and its rerun starts over. No path is overwritten while
it can be read.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

BUCKET = "bucket"
MANIFEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("version", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.StringType()),
        T.StructField("buckets", T.IntegerType()),
    ]
)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; its files keep their names, so a stream reads each of them once."""
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = here.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(there.getParent())
    if not system.rename(here, there):
        raise OSError(f"cannot move {source} to {target}")


class Conflict(Exception):
    """Another writer committed the version first; read again and decide anew."""


def move_if_absent(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name nobody has taken yet, else raise :class:`Conflict`.

    The file system decides, in one step where its rename is atomic.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    here, there = (fs.Path(p) for p in (source, target))
    system = there.getFileSystem(conf)
    here, there = system.makeQualified(here), system.makeQualified(there)
    rename = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        fs.FileContext.getFileContext(there.toUri(), conf).rename(here, there, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise Conflict(target) from error


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, on whatever file system its scheme names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def buckets_for(table_bytes: int, bucket_bytes: int = 1 << 30) -> int:
    """Number of buckets for a table of this size, a power of two."""
    return 1 << max(0, (max(1, table_bytes) - 1) // bucket_bytes).bit_length()


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64
    indexed: tuple[str, ...] = ()
    files: int = 1

    # --- versions -------------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v={version}"

    def _committed(self, version: int) -> bool:
        return path_exists(self.spark, f"{self._manifest(version)}/_SUCCESS")

    def _newest(self) -> int:
        """Newest committed version, -1 for none. Versions are numbered without gaps, so a
        few probes find it however many there are; no folder is listed."""
        if not self._committed(0):
            return -1
        low, step = 0, 1
        while self._committed(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._committed(middle) else (low, middle)
        return low

    def head(self) -> "Head | None":
        """The newest version, or None before the first commit."""
        newest = self._newest()
        return None if newest < 0 else self.version(newest)

    def version(self, number: int) -> "Head":
        rows = self.spark.read.schema(MANIFEST).parquet(self._manifest(number)).collect()
        held = {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}
        return Head(number, rows[0]["batch_id"], held, rows[0]["attempt"], rows[0]["buckets"])

    def _file_of(self) -> Column:
        """Which of a bucket's files a row goes to; spreads one bucket over several tasks."""
        upper = F.shiftrightunsigned(F.xxhash64(*self.keys), 33)
        return F.pmod(upper, F.lit(self.files)).cast("int")

    # --- reads ----------------------------------------------------------------

    def bucket_of(self, head: "Head | None" = None) -> Column:
        """The bucket of a row. A table keeps the number of buckets it was made with."""
        count = head.buckets if head is not None and head.buckets else self.buckets
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def read(
        self,
        version: int | None = None,
        buckets: Sequence[int] | None = None,
        head: "Head | None" = None,
    ) -> DataFrame:
        """A version of the table, whole or only some buckets of it."""
        if head is None:
            head = self.head() if version is None else self.version(version)
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.root}/data/v={v}/{BUCKET}={b}"
            for b, v in sorted(head.held.items() if head else ())
            if wanted is None or b in wanted
        ]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # --- commits --------------------------------------------------------------

    def touched(self, changes: DataFrame, head: "Head | None" = None) -> list[int]:
        """The buckets the keys of ``changes`` fall into, at most ``buckets`` numbers."""
        found = changes.select(self.bucket_of(head or self.head()).alias("b")).distinct().collect()
        return sorted(r["b"] for r in found)

    def commit(
        self,
        rows: DataFrame,
        buckets: Sequence[int] | None = None,
        batch_id: int = -1,
        head: "Head | None" = None,
        attempt: str | None = None,
        shared: bool = False,
    ) -> int:
        """Write ``rows`` as the new content of ``buckets`` (all when None).

        ``rows`` must hold every row of these buckets. The manifest names the ``attempt`` that
        made it. Returns the new version. A ``shared`` table has several writers: each works in folders
        of its own, and of two that start from the same ``head`` (None: no version yet) the later one
        gets :class:`Conflict` and leaves nothing behind.
        """
        head = head if shared else head or self.head()
        version = 0 if head is None else head.version + 1
        folder = version << 31 | random.getrandbits(31) if shared else version
        count = head.buckets if head is not None and head.buckets else self.buckets
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket_of(head))
        written = Observation()
        writer = (
            placed.repartition(F.col(BUCKET), self._file_of())
            .sortWithinPartitions(BUCKET, *self.indexed[:1], *self.keys)
            .observe(written, F.collect_set(BUCKET).alias("buckets"))
            .write.mode("overwrite")
            .partitionBy(BUCKET)
        )
        for name in self.indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer.parquet(f"{self.root}/data/v={folder}")
        held = {} if head is None or buckets is None else dict(head.held)
        for b in buckets or ():
            held.pop(b, None)
        # at most ``buckets`` numbers; buckets left without rows have no folder
        held.update({b: folder for b in written.get["buckets"]})
        manifest = self.spark.createDataFrame(
            [(b, v, batch_id, attempt, count) for b, v in sorted(held.items())]
            or [(None, version, batch_id, attempt, count)],
            MANIFEST,
        )
        if not shared:
            manifest.coalesce(1).write.mode("overwrite").parquet(self._manifest(version))
            return version
        staged = f"{self.root}/manifest/attempt={uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(staged)
        try:
            move_if_absent(self.spark, staged, self._manifest(version))
        except Conflict:
            remove(self.spark, staged)
            remove(self.spark, f"{self.root}/data/v={folder}")
            raise
        return version

    def create(self, rows: DataFrame | None = None) -> "Snapshot":
        """First version: the given rows or an empty table. An existing table stays."""
        if self.head() is None:
            self.commit(self.spark.createDataFrame([], self.schema) if rows is None else rows)
        return self


@dataclass(frozen=True)
class Head:
    """A version: its number, the batch and attempt that made it, bucket -> version holding it,
    and the number of buckets its rows are placed by."""

    version: int
    batch_id: int
    held: dict[int, int]
    attempt: str | None = None
    buckets: int | None = None

