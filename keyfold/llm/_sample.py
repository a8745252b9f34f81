"""Labelled rows for training: a bounded sample of fixed choice, and the fold that stays out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is of the fold that no label is learnt from; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class with labels, chosen by a hash of the id.

    Only rows outside of the held-out fold count. First, twice as many labels are drawn; the few
    drawn ids are then looked up in the documents, which stay where they are. Texts above
    ``max_chars`` are left out of the sample, so that its size is bounded; null texts, ids and
    labels are too. Of documents that repeat an id, one counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("int").alias("label")).where(
        ~held_out(F.col("_id")) & F.col("_id").isNotNull() & F.col("label").isin(0, 1)
    )

    def drawn(label: int) -> DataFrame:
        return own.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(2 * per_class)

    chosen = drawn(0).union(drawn(1)).groupBy("_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    found = (
        texts.where(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "_id")  # at most 4 * per_class rows of two numbers
        .groupBy("_id", "label")
        .agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("_id"), "_id")
        .select("text", "label")
    )
    out: list[tuple[str, int]] = []
    taken = {0: 0, 1: 0}
    for row in found.collect():
        if taken[row["label"]] < per_class:
            taken[row["label"]] += 1
            out.append((row["text"], row["label"]))
    return out
