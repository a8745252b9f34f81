"""Filter interaction audit: what each of five filters removes, alone and in every order.

The filters of a text: A under 200 words; B fewer distinct words than half of its words; C more
than 2 % of its code points are ``A`` to ``Z``; D holds any of ``#$%&*|``; E the same text stands
under a smaller ``doc_id``. Words are maximal runs without ASCII white space.

* **Counting-Bloom prepass.** Every task counts the cells of its texts' digests, up to two, and
  gives out only the cells it met; the counts are merged by blocks of cells. A text with a cell that
  was met once is unique for certain. The cells grow with the number of rows up to ``MOST_CELLS``;
  beyond that, more texts are only checked in vain.
* **Exact ids.** Only the texts left shuffle, whole, for the smallest id of each. Copies collapse in the
  tasks that read them, so a large group of copies costs one row per task. The row that holds the smallest
  id passes E, all others of that text fail it: rows look themselves up by (id, digest), which no group
  shares, never by text.
* **Additive counts.** A row's flags are a mask of five bits. Rows are counted by part and mask, at most
  32 counts a part; all 120 orders, their steps and the Shapley values are sums of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm._store import stored

FILTERS = "ABCDE"
#: Cells of the sketch for a row, and at most: a bit map of 64 MB is sent to all tasks then.
CELLS_PER_ROW = 8
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 29
#: Cells merged as one piece.
BLOCK = 1 << 16
#: Cells a task holds before it gives its counts out.
HELD = 1 << 21


def flags(text: Column) -> Column:
    """The mask of the filters A to D (bits 0 to 3) that a text fails."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    fails = [
        n < 200,
        100 * distinct < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each 64-bit hash."""
    h, mask = hashes.view(np.uint64), np.uint64(cells - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def repeated_cells(hashes: DataFrame, cells: int) -> np.ndarray:
    """One bit for every cell: whether two or more of the texts' hashes (one long column) met it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            met, times = np.unique(np.concatenate(held), return_counts=True)
            block = (met // BLOCK).astype(np.int32)
            packed = ((met % BLOCK).astype(np.uint32) << np.uint32(2)) | np.minimum(times, 2).astype(np.uint32)
            heads = np.flatnonzero(np.diff(block, prepend=-1))
            parts = [p.tobytes() for p in np.split(packed, heads[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(parts, pa.binary())], names=["block", "cells"])

        for batch in batches:
            one, two = _cells(batch.column(0).to_numpy(zero_copy_only=False), cells)
            # a text whose cells coincide meets its cell once
            held += [one, two[one != two]]
            n += 2 * len(one)
            if n > HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = np.frombuffer(packed.as_buffer(), np.uint32)
                mine = counts.setdefault(block, np.zeros(BLOCK, np.uint8))
                at = packed >> np.uint32(2)
                mine[at] = np.minimum(mine[at] + (packed & np.uint32(3)).astype(np.uint8), 2)
        if counts:
            bits = [np.packbits(c == 2).tobytes() for c in counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    found = np.zeros(cells // 8, np.uint8)
    merged = hashes.mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(merge, "block int, bits binary")
    for row in merged.collect():  # at most MOST_CELLS bits in all
        at = row["block"] * (BLOCK // 8)
        found[at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return found


def _maybe_repeated(spark: SparkSession, hashes: DataFrame, rows: int):
    """A function of a text's hash: False if no other row has the text for certain."""
    cells = LEAST_CELLS
    while cells < min(CELLS_PER_ROW * rows, MOST_CELLS):
        cells *= 2
    found = spark.sparkContext.broadcast(repeated_cells(hashes, cells))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        bits, result = found.value, np.ones(len(hashes), bool)
        for at in _cells(hashes.to_numpy(), cells):
            result &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1) == 1
        return pd.Series(result)

    return maybe


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row: the bits of the filters A to E that its text fails.

    A null text is empty, a null source the empty string. A row without ``doc_id`` neither fails E nor
    makes another row fail it; rows that repeat the smallest id of their text all pass E. Other columns are
    not looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    digest = F.unhex(F.sha2("text", 256))
    slim = stored(own.select("doc_id", "part", flags(F.col("text")).alias("mask"), digest.alias("digest")), "audit-rows")
    maybe = _maybe_repeated(spark, slim.select(F.xxhash64("digest")), slim.count())
    looked = own.select("doc_id", "text", F.xxhash64(digest).alias("h")).where("doc_id is not null").where(maybe("h"))
    firsts = looked.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", digest.alias("digest"), F.lit(True).alias("first"))
    rows = slim.withColumn("maybe", maybe(F.xxhash64("digest")) & F.col("doc_id").isNotNull())
    rows = stored(rows.withColumn("digest", F.when(F.col("maybe"), F.col("digest"))), "audit-rows")
    checked = (
        rows.where("maybe")
        .join(stored(firsts, "audit-firsts"), ["doc_id", "digest"], "left")
        .select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"))
    )
    return checked.unionByName(rows.where("not maybe").select("doc_id", "part", "mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows by part and mask, and how many are labelled so.

    A row counts as good if any label of its id says quality 1, as toxic if any says so.
    """
    facts = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        )
        .withColumn("_none", F.lit(False))
    )
    # rows without an id match nothing; a number of their own spreads them over the tasks
    keyed = rows.select(
        F.coalesce("doc_id", F.monotonically_increasing_id()).alias("_id"), F.col("doc_id").isNull().alias("_none"), "part", "mask"
    )
    return (
        keyed.join(facts, ["_id", "_none"], "left")
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def orders(counts: DataFrame) -> DataFrame:
    """All orders and steps of every part, from its mask counts."""
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    listed = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = (
        per_part.withColumn("filter_order", F.explode(listed))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
        .withColumn(
            "before",
            F.expr(
                "aggregate(sequence(0, step - 1), 0, (sum, k) -> sum + "
                f"if(k = 0, 0, shiftleft(1, instr('{FILTERS}', substr(filter_order, k, 1)) - 1)))"
            ),
        )
    )

    def total(value, where) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(where(c["mask"]), value(c)).otherwise(0))

    bit, before = F.col("bit"), F.col("before")

    def first(mask: Column) -> Column:
        return (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(before) == 0)

    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(lambda c: c["n"], first).alias("removed"),
        total(lambda c: c["n"], lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], first).alias("good_lost"),
        total(lambda c: c["toxic"], first).alias("toxic_lost"),
        # of the 120 orders, a filter comes before the others that a row fails in one of that many
        total(lambda c: c["n"] * (120 / F.bit_count(c["mask"])).cast("long"), lambda m: m.bitwiseAND(bit) != 0).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with the counts of that step, zeros included, for every source.

    See :func:`masks` for nulls and repeated rows. An empty table gives an empty result.
    """
    return orders(mask_counts(masks(docs), labels))


def oracle_sql() -> str:
    return r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flagged AS (
  SELECT doc_id, part,
         [CASE WHEN len(words) < 200 THEN 1 ELSE 0 END,
          CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END,
          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 1 ELSE 0 END,
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END,
          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END] AS fails
  FROM own),
facts AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flagged LEFT JOIN facts USING (doc_id) GROUP BY part, fails),
letters(l, k) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, ks[step] AS k, ks[1:step - 1] AS before FROM orders, range(1, 6) AS r(step)),
placed AS (
  SELECT part, filter_order, step, k, fails, n, good, toxic, fails[k] = 1 AS own,
         list_sum(list_transform(list_concat(before, [0]), lambda x: CASE WHEN x = 0 THEN 0 ELSE fails[x] END)) > 0 AS earlier,
         list_sum(fails) AS failing
  FROM counts, steps),
found AS (
  SELECT part, filter_order, step, any_value(k) AS k,
         sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN own AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM found"""
