"""Every link of the Jaccard join: how many documents each one links with, or all pairs of linked classes.

The join's groups come first. Within a group, answers are derived from one set's answers:

* The group's reference R is its class with most of the links that the join looked at. Of each set only
  its overlap with R and its difference from R (shingles in one of both) are kept. They give every overlap
  within the group exactly: ``|A & B| = |A & R| + |B & R| - |R| + |dA & dB|``.
* With ``score = (100 + percent) * |A & R| - percent * |A|``, two sets whose scores add up to
  ``(100 + percent) * |R|`` link whatever their differences are. Sets are cut into blocks in the order of
  group and score, so most pairs of blocks link as a whole or not at all, and only numbers are added up.
* The other pairs of blocks are compared by products of incidence matrices, in pieces of fixed size.

A block holds at most ``BLOCK_SETS`` sets and ``BLOCK_BYTES`` of differences (or one set), and no row stands
for a pair of sets unless pairs are asked for. Blocks are cut where rows lie after a sort by ranges, so a group
of any size is spread over tasks. A group of two classes needs none of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored, working
from keyfold.llm.jaccard_join import HOT_LIST, PERCENT, WORDS, _sets_of, grouped

BLOCK_SETS = 256
BLOCK_BYTES = 1 << 20
#: Shingles of a piece of an incidence matrix.
PIECE = 4096
#: Blocks of a group that meet all other blocks of it in one piece of the join.
BLOCKS_TOGETHER = 64

_PAYLOAD = ["sigs", "ns", "overlaps", "copies", "ends", "deltas"]
_BLOCK = (
    "block long, label long, base long, size long, weight long, low long, high long, spread long, small long, large long, "
    + ", ".join(f"{c} binary" for c in _PAYLOAD)
)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a set and its reference by their overlap and difference."""
    for batch in batches:
        overlaps, deltas = [], []
        for own, ref in zip(batch.column("items"), batch.column("ref_items"), strict=True):
            own, ref = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(ref.as_buffer(), np.uint64)
            delta = np.setxor1d(own, ref, assume_unique=True)
            overlaps.append((len(own) + len(ref) - len(delta)) // 2)
            deltas.append(delta.tobytes())
        kept = [batch.column(c) for c in ("sig", "label", "n", "copies", "base")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(overlaps, pa.int64()), pa.array(deltas, pa.binary())],
            names=["sig", "label", "n", "copies", "base", "overlap", "delta"],
        )


def _cut_into_blocks(percent: int):
    """Blocks of consecutive rows of one group; their numbers are unique over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def block() -> dict:
            sigs, labels, ns, copies, bases, overlaps, deltas = zip(*held, strict=True)
            n, overlap = np.array(ns), np.array(overlaps)
            score = (100 + percent) * overlap - percent * n
            lengths = [len(d) // 8 for d in deltas]
            arrays = [np.array(a, dtype=np.int64).tobytes() for a in (sigs, ns, overlaps, copies, np.cumsum(lengths))]
            meta = [number, labels[0], bases[0], len(n), sum(copies), score.min(), score.max(), max(lengths), n.min(), n.max()]
            return [*map(int, meta), *arrays, b"".join(deltas)]

        def given(blocks: list[list]) -> pa.RecordBatch:
            types = [pa.int64()] * 10 + [pa.binary()] * 6
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), types, strict=True)], names=names)

        for batch in batches:
            blocks = []
            for row in zip(*[c.to_pylist() for c in batch.columns[:7]], strict=True):
                if held and (row[1] != held[0][1] or len(held) == BLOCK_SETS or size + len(row[6]) > BLOCK_BYTES):
                    blocks.append(block())
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += len(row[6])
            if blocks:
                yield given(blocks)
        if held:
            yield given([block()])

    return run


def _read(batch: pa.RecordBatch, row: int, first: int) -> tuple[np.ndarray, ...]:
    """Arrays of a block, and of its differences the shingles with the places of their sets."""
    raw = [batch.column(first + k)[row].as_buffer() for k in range(len(_PAYLOAD))]
    sigs, ns, overlaps, copies, ends = (np.frombuffer(r, np.int64) for r in raw[:5])
    return sigs, ns, overlaps, copies, np.frombuffer(raw[5], np.uint64), np.repeat(np.arange(len(ns)), np.diff(ends, prepend=0))


def _common(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many shingles the differences of every two sets of two blocks share."""
    shared = np.intersect1d(a[4], b[4])
    found = np.zeros((len(a[0]), len(b[0])), dtype=np.int64)
    sides = []
    for side in (a, b):
        at = np.searchsorted(shared, side[4])
        held = at < len(shared)
        held[held] = shared[at[held]] == side[4][held]
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], side[5][held][order]))
    for start in range(0, len(shared), PIECE):
        width = min(PIECE, len(shared) - start)
        matrices = []
        for (at, row), side in zip(sides, (a, b), strict=True):
            first, last = np.searchsorted(at, [start, start + width])
            matrix = np.zeros((len(side[0]), width), dtype=np.float32)
            matrix[row[first:last], at[first:last] - start] = 1
            matrices.append(matrix)
        found += (matrices[0] @ matrices[1].T).astype(np.int64)
    return found


def _compared(percent: int, pairs: bool):
    """``sig, n`` (copies of the sets that a set links with, its own among them) or, for ``pairs``, links ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, alone = batch.column(0)[row].as_py(), not batch.column(1)[row].as_py()
                a = _read(batch, row, 2)
                b = a if alone else _read(batch, row, 2 + len(_PAYLOAD))
                overlap = a[2][:, None] + b[2] - base + _common(a, b)
                linked = (100 + percent) * overlap >= percent * (a[1][:, None] + b[1])
                if pairs:
                    x, y = np.nonzero(np.triu(linked, 1) if alone else linked)
                    found = [a[0][x], b[0][y]]
                    found = [np.minimum(*found), np.maximum(*found)]
                elif alone:
                    found = [a[0], linked @ a[3]]
                else:
                    found = [np.concatenate([a[0], b[0]]), np.concatenate([linked @ b[3], linked.T @ a[3]])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"] if pairs else ["sig", "n"])

    return run


def _each_member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sigs, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            sigs = np.frombuffer(sigs.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.full(len(sigs), n))], names=["sig", "n"])


def _blocks(docs: DataFrame, large: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """Blocks of the classes of ``large`` groups, each group against its reference."""
    spark = docs.sparkSession
    with working(spark) as kept:
        degree = found.select(F.col("a").alias("sig")).union(found.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
        refs = (
            large.join(degree, "sig")
            .groupBy("label")
            .agg(F.max(F.struct("links", "sig", "n")).alias("ref"))
            .select("label", F.col("ref.sig").alias("ref"), F.col("ref.n").alias("base"))
        )
        rows = stored(large.select("sig", "label", "n", "copies").join(stored(refs, "refs"), "label"), "large")
        items = _sets_of(docs, rows.select("sig"), size)
        sides = rows.join(items, "sig").join(items.toDF("ref", "ref_items"), "ref")
        schema = "sig long, label long, n long, copies long, base long, overlap long, delta binary"
        apart = stored(
            sides.select("sig", "label", "n", "copies", "base", "items", "ref_items").mapInArrow(_differences, schema), "differences"
        )
        score = ((100 + percent) * F.col("overlap") - percent * F.col("n")).alias("score")
        ordered = apart.select("*", score).repartitionByRange("label", "score", "sig").sortWithinPartitions("label", "score", "sig")
        return kept(ordered.mapInArrow(_cut_into_blocks(percent), _BLOCK), "blocks")


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b, base, sure, weight_a, weight_b``: every two blocks of a group that may hold a link, each also with itself.

    A group of many blocks meets itself in pieces of ``BLOCKS_TOGETHER`` blocks.
    """
    meta = blocks.drop(*_PAYLOAD)
    lots = meta.groupBy("label").agg(F.ceil(F.count("*") / F.lit(BLOCKS_TOGETHER)).cast("int").alias("pieces"))
    meta = stored(meta.join(lots, "label"), "meta")
    left = meta.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("a")
    right = meta.withColumn("piece", F.pmod(F.xxhash64("block"), F.col("pieces")).cast("int")).alias("b")
    c, whole = F.col, F.lit(100 + percent)
    bound = whole * c("a.base")
    return (
        left.join(right, (c("a.label") == c("b.label")) & (c("a.piece") == c("b.piece")) & (c("a.block") <= c("b.block")))
        .where(c("a.high") + c("b.high") + whole * F.least("a.spread", "b.spread") >= bound)
        .where((percent * c("b.small") <= 100 * c("a.large")) & (percent * c("a.small") <= 100 * c("b.large")))
        .select(
            c("a.block").alias("a"), c("b.block").alias("b"), c("a.base").alias("base"),
            (c("a.low") + c("b.low") >= bound).alias("sure"),
            c("a.weight").alias("weight_a"), c("b.weight").alias("weight_b"),
        )
    )


def _compare(blocks: DataFrame, todo: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """What :func:`_compared` finds in pairs of blocks; a block's pairs within itself take no join of two blocks."""
    schema = "a long, b long" if pairs else "sig long, n long"
    a = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in _PAYLOAD])
    b = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in _PAYLOAD])
    names = [f"{s}_{c}" for s in "ab" for c in _PAYLOAD]
    own = todo.where("a = b").join(a, "a").select("base", F.lit(False).alias("two"), *names[:6], *[F.lit(None).cast("binary").alias(n) for n in names[6:]])
    two = todo.where("a < b").join(a, "a").join(b, "b").select("base", F.lit(True).alias("two"), *names)
    return own.mapInArrow(_compared(percent, pairs), schema).union(two.mapInArrow(_compared(percent, pairs), schema))


def _counts(docs: DataFrame, per_class: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig, n``: the documents of the classes that each class of a group of three classes or more links with, and its own."""
    blocks = _blocks(docs, per_class.where("classes > 2"), found, size, percent)
    met = stored(_block_pairs(blocks, percent), "block-pairs")
    sure = met.where("sure")
    whole = sure.select(F.col("a").alias("block"), F.col("weight_b").alias("n")).union(sure.where("a <> b").select("b", "weight_a"))
    whole = blocks.select("block", "sigs").join(whole.groupBy("block").agg(F.sum("n").alias("n")), "block")
    parts = whole.select("sigs", "n").mapInArrow(_each_member, "sig long, n long").union(_compare(blocks, met.where("not sure"), percent, False))
    return parts.groupBy("sig").agg(F.sum("n").alias("n"))


def _classes(docs: DataFrame, size: int, percent: int, hot_list: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``jaccard_join.grouped``, the classes also with their group's ``component, classes, documents``."""
    own, per_class, found = grouped(docs, size, percent, hot_list)
    group = per_class.groupBy("label").agg(
        F.min("least").alias("component"), F.count("*").alias("classes"), F.sum("copies").alias("documents")
    )
    return own, stored(per_class.join(group, "label"), "grouped"), found


def report(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_links`` for every row.

    ``n_links`` counts the other rows whose sets link with the row's, those with the same set among them, over
    all links. ``class_id`` is the smallest ``doc_id`` with the same set, ``component_id`` the smallest that links
    reach. A null or empty text, or one without words, links with nothing and has its own ``doc_id`` in both. Rows that
    repeat a ``doc_id`` or have none are rows of their own; classes and components of rows without ``doc_id`` have
    a null id. An empty table gives an empty one.
    """
    with working(docs.sparkSession) as kept:
        own, per_class, found = _classes(docs, size, percent, hot_list)
        counts = stored(_counts(docs, per_class, found, size, percent), "counts")
        # a group of one or two classes links as a whole
        total = F.when(F.col("classes") > 2, F.col("n_linked")).otherwise(F.col("documents"))
        to = per_class.join(counts.toDF("sig", "n_linked"), "sig", "left").select(
            F.col("sig").alias("_sig"), "component", F.col("least").alias("class"), (total - 1).alias("links")
        )
        # texts without words have no class: a key of their own keeps them out of one task
        own = own.withColumn("key", F.coalesce("sig", F.xxhash64("doc_id", F.lit("none"))))
        none = F.col("sig").isNull()
        rows = own.join(to, (F.col("key") == F.col("_sig")) & ~none, "left").select(
            "doc_id", F.col("n").alias("n_shingles"),
            *[F.when(none, F.col("doc_id")).otherwise(F.col(c)).alias(f"{c}_id") for c in ("component", "class")],
            F.when(none, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        )
        return kept(rows, "links-report")


def pairs(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST) -> DataFrame:
    """``a, b``: every two classes that link, once, ``a < b`` being their ``sig``.

    ``jaccard_join.classes`` gives every row's class. The result grows with the number of links.
    """
    with working(docs.sparkSession) as kept:
        _, per_class, found = _classes(docs, size, percent, hot_list)
        blocks = _blocks(docs, per_class.where("classes > 2"), found, size, percent)
        met = stored(_block_pairs(blocks, percent), "block-pairs")
        two = per_class.where("classes = 2").groupBy("label").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).select("a", "b")
        return kept(two.union(_compare(blocks, met, percent, True)), "pairs")
