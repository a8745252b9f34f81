"""N-gram Jaccard join by set-relation skipping: exact links and groups of similar texts.

A text's set is its distinct word shingles. Texts with the same set are one class; sets link if
``100 * |A & B| >= percent * |A | B|``. The join is exact:

* Shingles are ordered by how frequent they are, from a count sketch of fixed size over all
  documents (any order is right; a good one makes short lists). If two sets link, the first
  shingle they share, in that order, lies at a place ``<= |A| - a`` of A and ``<= |B| - a`` of B,
  ``a`` being the overlap that their sizes need. Only shingles at places that allow some
  partner are listed.
* **Lists are skipped by place.** A shingle's list is ordered by place. Its first set, the
  pivot, is compared with those whose size and place still allow a link; the rest is skipped.
* **Answers come from similar sets.** Sets that link to a pivot are in its group, so none of
  their pairs is looked at again. A list that lies in one group is finished. In the others,
  each set outside of the pivot's group meets the rest of the list; its known overlap with the
  pivot bounds its overlap with every other set from above, which skips most pairs, and
  from below, which gives links without a look at the sets.
* What is left is verified on the sets themselves.

Hot shingles are spread over several lists by their sketch count, each with its own pivot.
Copies of a set become one class in the task that reads them. Links are never gathered on the
driver. The sketch and a bit map of the sets to verify are the only things sent to all tasks;
both have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm._store import stored, working
from keyfold.llm._words import distinct, each, mix, sequence_hash, signed

WORDS = 5
PERCENT = 75
#: Counters of the frequency sketch, in blocks of ``BLOCK``: 4 MB at any input size.
COUNTERS = 1 << 20
BLOCK = 1 << 14
#: A list with more sets than this (by the sketch) is spread over several.
HOT_LIST = 100_000
#: Whole lists up to this length lose the rows that no other row of theirs can link with.
SHORT_LIST = 16
#: Bits that mark the sets to verify: 4 MB at any input size. More sets only let through sets that the join drops.
MARKS = 1 << 25


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((F.lit(percent) * (a + b)) / F.lit(100 + percent))


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text."""
    for first, last, words in each(column, "space"):
        shingles, _ = words.shingles(size)
        for d in range(last - first):
            a, b = words.first[d], words.first[d + 1]
            if b - a >= size:
                yield first + d, distinct(shingles[a : b - size + 1])
            elif b > a:
                yield first + d, np.array([sequence_hash(words.hashes[a:b])], dtype=np.uint64)
            else:
                yield first + d, np.zeros(0, dtype=np.uint64)


def _signature(own: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its sorted shingles."""
    place = np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(signed(mix(np.array([np.bitwise_xor.reduce(mix(own + place))], dtype=np.uint64) + np.uint64(len(own))))[0])


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame, size: int = WORDS, key: str | None = None) -> DataFrame:
    """``doc_id, n, sig``, and ``row`` if ``docs`` has a ``key``, per row; a text without words has ``n`` 0 and a null ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = [0] * batch.num_rows, [None] * batch.num_rows
            for row, own in _sets(batch.column(1), size):
                if len(own):
                    n[row], sig[row] = len(own), _signature(own)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "row"][: len(columns)])

    text = _text(docs)
    if key:
        text = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"))], F.col(key).alias("row"))
    return text.mapInArrow(run, "doc_id long, n long, sig long" + (f", row {docs.schema[key].dataType.simpleString()}" if key else ""))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of counters that reach a task, one at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            counts = np.frombuffer(counts.as_buffer(), dtype=np.uint32)
            total[block] = np.minimum(total.get(block, np.uint64(0)) + counts.astype(np.uint64), np.uint64(2**32 - 1))
    if total:
        yield _blocks({b: c.astype(np.uint32) for b, c in total.items()}, 0)


def _blocks(counts: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(counts), pa.int32()),
            pa.array([salt] * len(counts), pa.int32()),
            pa.array([c.tobytes() for c in counts.values()], pa.binary()),
        ],
        names=["block", "salt", "counts"],
    )


def frequencies(docs: DataFrame, size: int = WORDS) -> np.ndarray:
    """How often shingles occur in all documents, by the low bits of their hash; a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, rows = np.zeros(COUNTERS, dtype=np.uint32), [], 0

        def count() -> None:
            places = (np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64)
            counts[:] += np.bincount(places, minlength=COUNTERS).astype(np.uint32)
            held.clear()

        for batch in batches:
            for _, own in _sets(batch.column(1), size):
                held.append(own)
                rows += len(own)
                if rows > COUNTERS:
                    count()
                    rows = 0
        if held:
            count()
        if counts.any():
            parts = {k: counts[k * BLOCK : (k + 1) * BLOCK] for k in range(COUNTERS // BLOCK)}
            yield _blocks(parts, int(counts.sum() % 16))

    schema = "block int, salt int, counts binary"
    sums = _text(docs).mapInArrow(run, schema)
    for keys in (["block", "salt"], ["block"]):
        sums = sums.repartition(*keys).mapInArrow(_add_up, schema)
    found = np.zeros(COUNTERS, dtype=np.uint32)
    for row in sums.collect():
        found[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.uint32)
    return found


def postings(docs: DataFrame, counts, size: int, percent: int, hot_list: int) -> DataFrame:
    """``token, salt, sig, n, pos`` for the shingles of each set that can be the first it shares with another.

    ``salt`` is 0, or from 1 on for the lists of a hot shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for batch in batches:
            parts: list[tuple] = []
            rows = 0
            for _, own in _sets(batch.column(1), size):
                n = len(own)
                if n == 0 or (sig := _signature(own)) in seen:
                    continue
                seen.add(sig)
                found = table[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
                places = n - -(-percent * n // 100) + 1
                order = np.lexsort((own, found))[:places]
                spread = 1 + found[order].astype(np.int64) // hot_list
                salts = np.where(spread > 1, 1 + (sig & 0x7FFFFFFF) % spread, 0)
                parts.append((signed(own[order]), salts, np.full(places, sig), np.full(places, n), np.arange(places)))
                rows += places
                if rows > 50_000:
                    yield _rows(parts)
                    parts, rows = [], 0
            if parts:
                yield _rows(parts)

    return _text(docs).mapInArrow(run, "token long, salt long, sig long, n long, pos long")


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "salt", "sig", "n", "pos"])


def _useful(rows: np.ndarray, heads: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of whole short lists can link to another row of theirs, and each row's first such row.

    Rows that no other row's size and place allow a link with are skipped here, before they
    cost anything; a longer list keeps all of its rows.
    """
    keep = np.ones(rows.shape[1], dtype=bool)
    lead = np.repeat(heads, sizes)
    for size in range(2, SHORT_LIST + 1):
        at = heads[(sizes == size) & (rows[1, heads] == 0)][:, None] + np.arange(size)
        sig, n, pos = rows[2][at], rows[3][at], rows[4][at]
        needed = -(-percent * (n[:, :, None] + n[:, None, :]) // (100 + percent))
        fits = pos[:, :, None] <= n[:, :, None] - needed
        some = (fits & fits.transpose(0, 2, 1) & (sig[:, :, None] != sig[:, None, :])).any(axis=2)
        keep[at] = some
        lead[at] = (at[:, 0] + some.argmax(axis=1))[:, None]
    return keep, lead


def _with_pivots(percent: int):
    """Rows of lists that hold more than one set, or are one of several, each with the list's pivot.

    Rows come ordered by list and place; the pivot is the first. Only the first row of a list that
    goes on in the next batch is kept in memory.
    """
    names = ["token", "salt", "sig", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, alone = None, False  # the open list's first row; whether it is still to be given out
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            if not rows.shape[1]:
                continue
            if pivot is not None:
                rows = np.concatenate([pivot, rows], axis=1)
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, rows.shape[1]))
            # lists that this batch may not hold in full keep all of their rows
            whole = slice(0 if pivot is None else 1, len(heads) - 1)
            keep, first = np.ones(rows.shape[1], dtype=bool), np.repeat(heads, sizes)
            if len(heads[whole]):
                a, b = heads[whole][0], heads[-1]
                keep[a:b], inner = _useful(rows[:, a:b], heads[whole] - a, sizes[whole], percent)
                first[a:b] = inner + a
            lead = rows[:, first]
            is_lead = first == np.arange(len(first))
            out = keep & ((np.repeat(sizes, sizes) > 1) | (rows[1] > 0)) & ((rows[2] != lead[2]) | is_lead)
            if pivot is not None and not alone:
                out[0] = False
            is_open = heads[-1]
            alone = sizes[-1] == 1 and rows[1, is_open] == 0 and (is_open > 0 or pivot is None or alone)
            pivot = rows[:, is_open : is_open + 1]
            chosen = np.concatenate([rows[:, out], lead[2:, out]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in chosen], names=[*names, "p_sig", "p_n", "p_pos"])

    return run


def _compatible(n: Column, pos: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can link if the first they share has these places."""
    a = _needed(n, m, percent)
    return (pos <= n - a) & (other <= m - a)


def _marked(spark: SparkSession, need: DataFrame):
    """A bit map of fixed size with a bit for every ``sig``, for all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column(0).to_numpy().view(np.uint64) % np.uint64(MARKS)
            for block in np.unique(bits >> np.uint64(15)).tolist():
                mine = blocks.setdefault(block, np.zeros(1 << 15, dtype=bool))
                mine[(bits[(bits >> np.uint64(15)) == block] & np.uint64((1 << 15) - 1)).astype(np.int64)] = True
        if blocks:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blocks), pa.int32()), pa.array([np.packbits(b).tobytes() for b in blocks.values()], pa.binary())],
                names=["block", "bits"],
            )

    block = F.shiftright(F.pmod(F.col("sig"), F.lit(MARKS)), 15)
    found = np.zeros(MARKS // 8, dtype=np.uint8)
    for row in need.select("sig").repartition(block).mapInArrow(run, "block int, bits binary").collect():
        at = row["block"] << 12
        found[at : at + (1 << 12)] |= np.frombuffer(row["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(found)


def _sets_of(docs: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """``sig, items`` (sorted shingles, packed) of the wanted classes, one row each, dealt by ``sig``."""
    marks = _marked(docs.sparkSession, need)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sigs, items, held = [], [], 0
            for _, own in _sets(batch.column(1), size):
                if not len(own) or (sig := _signature(own)) in seen:
                    continue
                bit = (sig % 2**64) % MARKS
                if marks.value[bit >> 3] >> (7 - (bit & 7)) & 1:
                    seen.add(sig)
                    sigs.append(sig)
                    items.append(own.tobytes())
                    held += len(items[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(items, pa.binary())], names=["sig", "items"])
                        sigs, items, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(items, pa.binary())], names=["sig", "items"])

    found = _text(docs).mapInArrow(run, "sig long, items binary").join(need.select("sig"), "sig", "left_semi")
    return found.groupBy("sig").agg(F.first("items").alias("items"))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        overlap = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            both = np.concatenate([np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)])
            both.sort()
            overlap.append(int(np.count_nonzero(both[1:] == both[:-1])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"])


def _verified(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``a, b, overlap``: the exact overlap of each pair of sets.

    Sets are dealt by ``sig`` once and meet their pairs there; a pair then takes the set of ``a`` along to that of ``b``.
    """
    need = stored(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct(), "need")
    items = _sets_of(docs, need, size)
    sides = pairs.join(items.toDF("a", "a_items"), "a").join(items.toDF("b", "b_items"), "b")
    return stored(sides.select("a", "b", "a_items", "b_items").mapInArrow(_overlaps, "a long, b long, overlap long"), "overlaps")


def groups(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links (a, b)``: its group's smallest node.

    Every round, a node takes the smallest label around it, and then that label's own label.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels, edges["a"] == labels["node"])
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = stored(
            hooked.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("upper", "label")).alias("label")),
            "labels",
        )
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST) -> DataFrame:
    """``a, b``: links between classes that connect every two classes that links connect.

    Not every link is listed: within a group, enough of them to hold it together.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(docs, size))
    lists = (
        postings(docs, counts, size, percent, hot_list)
        .repartition("token", "salt")
        .sortWithinPartitions("token", "salt", "pos", "n", "sig")
        .mapInArrow(
            _with_pivots(percent),
            "token long, salt long, sig long, n long, pos long, p_sig long, p_n long, p_pos long",
        )
    )
    lists = stored(lists, "lists")
    enough = F.col("overlap") >= _needed(F.col("n"), F.col("p_n"), percent)

    # every set with the pivots of its lists; a hot shingle's pivots with the first of them
    hot = lists.where("salt > 0").groupBy("token").agg(F.min(F.struct("p_pos", "p_n", "p_sig")).alias("first"))
    between = lists.join(hot, "token").select(
        F.col("p_sig").alias("sig"), F.col("p_n").alias("n"), F.col("p_pos").alias("pos"),
        F.col("first.p_sig").alias("p_sig"), F.col("first.p_n").alias("p_n"), F.col("first.p_pos").alias("p_pos"),
    )
    star = (
        lists.select(*between.columns)
        .unionByName(between)
        .where((F.col("sig") != F.col("p_sig")) & _compatible(F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos"), percent))
        .select("sig", "n", "p_sig", "p_n")
        .distinct()
    )
    star = stored(star, "star")
    known = _verified(docs, star.select(F.col("sig").alias("a"), F.col("p_sig").alias("b")), size)
    star = star.join(known.toDF("sig", "p_sig", "overlap"), ["sig", "p_sig"]).withColumn("linked", enough)
    star = stored(star, "star")
    first = star.where("linked").select(F.col("sig").alias("a"), F.col("p_sig").alias("b"))
    label = groups(first)

    def labelled(df: DataFrame, sig: str, name: str) -> DataFrame:
        own = label.toDF(sig, "_label")
        return df.join(own, sig, "left").withColumn(name, F.coalesce("_label", sig)).drop("_label")

    # lists with a set outside of the group of the shingle's first pivot
    members = lists.select("token", "sig", "n", "pos", "p_sig")
    heads = lists.select("p_sig", "sig").distinct()
    heads = labelled(labelled(heads, "sig", "own"), "p_sig", "lead")
    heads = stored(heads.join(star.select("sig", "p_sig", "overlap", "p_n"), ["sig", "p_sig"], "left"), "heads")
    hot_tokens = lists.where("salt > 0").select("token").distinct()
    outside = members.join(heads.where("own <> lead").select("sig", "p_sig"), ["sig", "p_sig"], "left_semi").select("token")
    open_ = stored(outside.union(hot_tokens).distinct(), "open")
    members = stored(members.join(open_, "token", "left_semi").join(heads, ["sig", "p_sig"]), "members")
    # the group that most of an open list is in needs no look within itself
    sizes = members.groupBy("token", "own").agg(F.count("*").alias("n"))
    # both are stored, so that a hot shingle's rows are only ever joined, and Spark can split them
    main = stored(sizes.groupBy("token").agg(F.max_by("own", F.struct("n", "own")).alias("main")), "main")
    left = stored(members.join(main, "token").where("own <> main").drop("main"), "left")
    # linked sets are in the same band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / min(percent, 99))))
    left = left.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    x, y = left.alias("x"), members.withColumn("band", band).alias("y")
    c = F.col
    same = c("x.p_sig") == c("y.p_sig")
    upper = F.least(c("x.overlap"), c("y.overlap")) + F.least(c("x.n") - c("x.overlap"), c("y.n") - c("y.overlap"))
    lower = c("x.overlap") + c("y.overlap") - c("x.p_n")
    needed = _needed(c("x.n"), c("y.n"), percent)
    cross = (
        x.join(y, (c("x.token") == c("y.token")) & (c("x.band") == c("y.band")))
        .where(c("x.own") != c("y.own"))
        .where(_compatible(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"), percent))
        .where(~(same & F.coalesce(upper < needed, F.lit(False))))
        .where((c("x.sig") != c("y.p_sig")) & (c("y.sig") != c("x.p_sig")))
        .select(
            F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"),
            F.coalesce(same & (lower >= needed), F.lit(False)).alias("sure"),
            F.least("x.n", "y.n").alias("n"), F.greatest("x.n", "y.n").alias("p_n"),
        )
        .groupBy("a", "b", "n", "p_n")
        .agg(F.max("sure").alias("sure"))
    )
    cross = stored(cross, "cross")
    checked = _verified(docs, cross.where("not sure").select("a", "b"), size).join(cross.where("not sure"), ["a", "b"])
    return stored(
        reduce(DataFrame.union, [first, cross.where("sure").select("a", "b"), checked.where(enough).select("a", "b")]), "links"
    )


def grouped(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST, key: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's class, every class with its group, and links that hold the groups together, all stored.

    The classes have ``sig, n, copies, least`` (smallest ``doc_id``) and ``label``, with a ``key`` also ``head``.
    The lists and sets that this takes are deleted at its end.
    """
    spark = docs.sparkSession
    own = stored(classes(docs, size, key), "classes")
    with working(spark) as kept:
        found = kept(links(docs, size, percent, hot_list), "links")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    with working(spark) as kept:
        label = groups(found).toDF("sig", "label")
        per_class = (
            own.where("sig is not null")
            .groupBy("sig")
            .agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), *([F.min(rank).alias("head")] if key else []))
            .join(label, "sig", "left")
            .withColumn("label", F.coalesce("label", "sig"))
        )
        per_class = kept(per_class, "per-class")
    return own, per_class, found


def components(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, hot_list: int = HOT_LIST, key: str | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest ``doc_id`` that links reach. A null or empty text, or one
    without words, has no shingles and reaches only itself. Rows that repeat a ``doc_id`` or have
    none are rows of their own; a component of rows without ``doc_id`` has a null id. A column
    ``key`` of ``docs`` that is unique and stored is given too, with ``is_first``: whether a row is its component's
    first by ``doc_id``, nulls last, and ``key``. An empty table gives an empty one.
    """
    own, per_class, _ = grouped(docs, size, percent, hot_list, key)
    least = per_class.groupBy("label").agg(F.min("least").alias("component"), *([F.min("head").alias("head")] if key else []))
    to = per_class.select("sig", "label").join(least, "label").select("sig", "component", *([F.col("head.row").alias("head")] if key else []))
    # texts without words have no class: a key of their own keeps them out of one task
    class_key = F.coalesce("sig", F.xxhash64("doc_id", F.lit("none")))
    return (
        own.withColumn("key", class_key)
        .join(to.withColumnRenamed("sig", "_sig"), (F.col("key") == F.col("_sig")) & F.col("sig").isNotNull(), "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
            *([F.col("row").alias(key), (F.col("sig").isNull() | (F.col("row") == F.col("head"))).alias("is_first")] if key else []),
        )
    )
