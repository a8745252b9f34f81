"""Substring dedup: hash lines and phrases, keep the earliest occurrence, remove the others.

Words are compared with A-Z lower-cased; white space between them does not count. The earliest
occurrence, by ``doc_id`` and place, stays. Of the others go:

* whole lines of ``min_line_words`` words or more;
* every passage of ``min_words`` words or more, wherever it stands, also within or across lines.
  Phrases of ``k`` words are hashed; of every ``w`` phrases next to each other the one with the
  smallest hash counts, ``k + w - 1 = min_words``, so two places with the same ``min_words`` words
  share a phrase. Counted phrases of a repeated passage overlap or touch (``w <= k``). Their run is
  extended word by word to both sides as far as the words are those at the first occurrence of
  its outermost phrase. Less than ``w`` words are equal there: with more the next phrase counts.

Digests are grouped by an aggregation that keeps one row per digest and task, so a phrase that
a third of all documents hold is no large group; its occurrences meet that row in a join
whose skewed partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm._store import stored, sweep, working
from keyfold.llm._words import U64, Words, each, mix, signed

MIN_WORDS = 16


def _sizes(min_words: int) -> tuple[int, int]:
    """Words of a phrase, and how many neighbours one is chosen from."""
    w = max(1, min_words // 2)
    return min_words + 1 - w, w


def _line_starts(words: Words) -> np.ndarray:
    """The first word of every line."""
    n = len(words.hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    breaks = np.concatenate([[0], np.cumsum(words.raw == 10)])
    line = np.zeros(n, dtype=bool)
    at = breaks[words.starts]
    line[0] = True
    line[1:] = at[1:] != at[:-1]
    firsts = words.first[:-1]
    line[firsts[firsts < n]] = True
    return np.flatnonzero(line)


def _digests(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words of each unit, and the word behind it."""
    ends = np.append(starts[1:], len(words.hashes))
    powers = np.multiply.accumulate(np.full(len(words.hashes) + 1, U64(0xD6E8FEB86659FD93), dtype=U64))
    sums = np.concatenate([[U64(0)], np.cumsum(words.hashes * powers[:-1])])
    # a unit's sum begins with a power of its place, which the inverse takes away
    inverse = np.multiply.accumulate(np.full(len(words.hashes) + 1, U64(pow(0xD6E8FEB86659FD93, -1, 2**64)), dtype=U64))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64)), ends


def _phrases(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the phrases that count, and their first words."""
    hashes, ok = words.shingles(k)
    if len(hashes) < w:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    whole = np.flatnonzero(ok[: len(ok) - w + 1] & ok[w - 1 :])
    least, at = hashes[whole], whole.copy()
    for j in range(1, w):
        less = hashes[whole + j] < least
        least = np.where(less, hashes[whole + j], least)
        at[less] = whole[less] + j
    at = np.unique(at)
    return hashes[at], at


def _lists(counts: list[np.ndarray], fields: list[list[np.ndarray]], kind: pa.ListType) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    values = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(f), t.type) if f else pa.array([], t.type) for f, t in zip(fields, kind.value_type, strict=True)],
        fields=list(kind.value_type),
    )
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _struct_list(**fields: pa.DataType) -> pa.ListType:
    return pa.list_(pa.struct(list(fields.items())))


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, doc_id, n, phrases: array<struct<digest, place>>, lines: array<struct<digest, place, words>>``.

    ``place`` counts words of the text, ``n`` is their number. A null text has no units.
    """
    k, w = _sizes(min_words)
    schema = """row long, doc_id long, n int, phrases array<struct<digest:long,place:int>>,
        lines array<struct<digest:long,place:int,words:int>>"""
    small = _struct_list(digest=pa.int64(), place=pa.int32())
    large = _struct_list(digest=pa.int64(), place=pa.int32(), words=pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases: list[list[np.ndarray]] = [[], []]
            lines: list[list[np.ndarray]] = [[], [], []]
            n_phrases, n_lines, n = [], [], []
            for _, _, words in each(batch.column(2), "space"):
                rows = len(words.first) - 1
                n.append(np.diff(words.first))
                digests, at = _phrases(words, k, w)
                doc = np.searchsorted(words.first, at, "right") - 1
                n_phrases.append(np.bincount(doc, minlength=rows))
                for out, values in zip(phrases, (signed(digests), at - words.first[doc]), strict=True):
                    out.append(values)
                starts = _line_starts(words)
                digests, ends = _digests(words, starts)
                doc = np.searchsorted(words.first, starts, "right") - 1
                n_lines.append(np.bincount(doc, minlength=rows))
                for out, values in zip(lines, (signed(digests), starts - words.first[doc], ends - starts), strict=True):
                    out.append(values)
            counts = pa.array(np.concatenate(n) if n else [], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), counts, _lists(n_phrases, phrases, small), _lists(n_lines, lines, large)],
                names=["row", "doc_id", "n", "phrases", "lines"],
            )

    return _keyed(docs).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that is the same for rows equal in ``doc_id`` and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def _occurrences(found: DataFrame, name: str) -> DataFrame:
    """The units in column ``name``, one row each; a row without ``doc_id`` ranks last."""
    each_unit = found.select("row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.explode(name).alias("unit"))
    return each_unit.select("row", "doc_id", "unit.*")


def _again(found: DataFrame, name: str) -> DataFrame:
    """Later occurrences of the units in column ``name``, with the first one's ``first_row, first_place``.

    Occurrences come as often as their row does. The first ones are stored, so that the shuffle that finds them is
    gone before all occurrences are shuffled to meet them.
    """
    first = (
        _occurrences(found, name)
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "row", "place")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place"))
    )
    first = stored(first, f"first-{name}")
    sweep(found.sparkSession)
    return (
        _occurrences(found, name)
        .drop("doc_id")
        .join(first, "digest")
        .where((F.col("row") != F.col("first_row")) | (F.col("place") != F.col("first_place")))
        .drop("digest")
    )


def _ends(found: DataFrame, k: int) -> DataFrame:
    """``row, side, place, first_row, first_place, most``: the outermost phrases of every run, and their first occurrences.

    ``side`` is 0 for the run's first phrase and 1 for its last. ``most`` is how many words the run may at most be
    extended to that side, null where nothing limits it.
    """
    # one shuffle by row serves all that follows
    again = _again(found, "phrases").repartition("row").distinct()
    # a phrase that overlaps its own first occurrence would take words of that
    again = again.where((F.col("row") != F.col("first_row")) | (F.col("place") >= F.col("first_place") + k))
    by_place = Window.partitionBy("row").orderBy("place")
    new = F.coalesce((F.col("place") - F.lag("place").over(by_place) > k).cast("long"), F.lit(1).cast("long"))
    one = F.struct("place", "first_row", "first_place")
    runs = (
        again.withColumn("new", new)
        .withColumn("run", F.sum("new").over(by_place))
        .groupBy("row", "run")
        .agg(F.min(one).alias("l"), F.max(one).alias("r"))
    )
    sides = F.array(*[F.struct(F.lit(side).cast("int").alias("side"), f"{name}.*") for side, name in enumerate("lr")])
    # not into the first occurrence in the same text
    most = F.when((F.col("side") == 0) & (F.col("row") == F.col("first_row")), F.col("place") - F.col("first_place") - k)
    return runs.select("row", F.explode(sides).alias("x")).select("row", "x.*").withColumn("most", most.cast("int"))


def _beside(words: Words, at: np.ndarray, side: np.ndarray, doc: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``w`` words beside the phrases at ``at``, going away from them, and which of them exist."""
    step = np.arange(w)
    index = np.where(side[:, None] == 0, at[:, None] - 1 - step, at[:, None] + k + step)
    ok = (index >= words.first[doc][:, None]) & (index < words.first[doc + 1][:, None])
    return words.hashes[np.where(ok, index, at[:, None])], ok


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every value of the lists the row it is in, where the rows begin, and the values."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), counts), np.concatenate([[0], np.cumsum(counts)]), column.flatten()


def _field(values: pa.StructArray, name: str) -> np.ndarray:
    return pc.struct_field(values, name).to_numpy(zero_copy_only=False)


def _first_words(docs: DataFrame, ends: DataFrame, k: int, w: int) -> DataFrame:
    """``first_row, first_place, side, words``: the ``w`` words beside the first occurrences, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, bounds, asked = _flat(batch.column(2))
            place, side = _field(asked, "place"), _field(asked, "side")
            counts, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for begin, end, words in each(batch.column(1), "space"):
                part = slice(bounds[begin], bounds[end])
                own = doc[part] - begin
                hashes, ok = _beside(words, words.first[own] + place[part], side[part], own, k, w)
                counts.append(ok.sum(axis=1))
                values.append(signed(hashes[ok]))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            rows = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(place, pa.int32()), pa.array(side, pa.int32()), lists], names=["first_row", "first_place", "side", "words"]
            )

    asked = ends.groupBy(F.col("first_row").alias("row")).agg(F.collect_set(F.struct(F.col("first_place").alias("place"), "side")).alias("asked"))
    texts = _keyed(docs).join(asked, "row").select("row", "text", "asked")
    return texts.mapInArrow(run, "first_row long, first_place int, side int, words array<long>")


def _marks(docs: DataFrame, min_words: int, min_line_words: int, each_row: bool = False) -> DataFrame:
    """What ``_cut`` needs, a stored row for every ``row`` that loses anything.

    ``lines: array<struct<place, words>>``, ``ends: array<struct<place, side, most, words>>`` and, of rows that come
    more than once, the number ``n`` of their words. Each step is stored and the one before deleted, with its shuffle files.
    """
    spark = docs.sparkSession
    k, w = _sizes(min_words)
    with working(spark) as kept:
        with working(spark) as kept_beyond_units:
            found = stored(units(docs, min_words), "units")
            ends = kept_beyond_units(_ends(found, k), "ends")
            sweep(spark)
            long = found.withColumn("lines", F.filter("lines", lambda x: x["words"] >= min_line_words))
            parts = _again(long, "lines").select("row", F.struct("place", "words").alias("line"))
            if each_row:
                copies = found.where("n > 0").groupBy("row").agg(F.count("*").alias("copies"), F.first("n").cast("long").alias("n"))
                parts = parts.unionByName(copies.where("copies > 1").drop("copies"), allowMissingColumns=True)
            parts = kept_beyond_units(parts, "parts")
        first_words = stored(_first_words(docs, ends, k, w), "first-words")
        sweep(spark)
        keys = ["first_row", "first_place", "side"]
        met = ends.join(first_words.groupBy(*keys).agg(F.first("words").alias("words")), keys)
        parts = parts.unionByName(met.select("row", F.struct("place", "side", "most", "words").alias("end")), allowMissingColumns=True)
        marks = [F.collect_set("line").alias("lines"), F.collect_list("end").alias("ends"), *([F.max("n").alias("n")] if each_row else [])]
        return kept(parts.groupBy("row").agg(*marks), "marks")


def _cut(marked: DataFrame, min_words: int) -> DataFrame:
    """The rows of ``marked`` with ``spans: array<struct<start, end, words>>`` in place of their ``lines`` and ``ends``.

    Runs are extended to both sides as far as the words are those beside the first occurrence. Passages and lines
    that overlap or touch are one span.
    """
    k, w = _sizes(min_words)
    kind = _struct_list(start=pa.int32(), end=pa.int32(), words=pa.int32())
    names = marked.columns
    others = [c for c in names if c not in ("lines", "ends")]

    def extended(words: Words, doc: np.ndarray, ends: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages of ``min_words`` words or more: their document, first word, and the word behind them."""
        at, side = words.first[doc] + _field(ends, "place"), _field(ends, "side")
        own, ok = _beside(words, at, side, doc, k, w)
        which, bounds, hashes = _flat(pc.struct_field(ends, "words"))
        other, held = np.zeros((len(doc), w), dtype=np.int64), np.zeros((len(doc), w), dtype=bool)
        column = np.arange(len(which)) - bounds[which]
        other[which, column], held[which, column] = hashes.to_numpy(), True
        equal = np.logical_and.accumulate((signed(own) == other) & ok & held, axis=1).sum(axis=1)
        equal = np.minimum(equal, pc.fill_null(pc.struct_field(ends, "most"), w).to_numpy())
        # runs don't overlap, so the two ends of each come one after the other
        order = np.lexsort((side, at))
        left, right = order[0::2], order[1::2]
        begin, behind = at[left] - equal[left], at[right] + k + equal[right]
        long = behind - begin >= min_words
        return doc[left][long], begin[long], behind[long]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = dict(zip(names, batch.columns, strict=True))
            some = pc.or_(*[pc.greater(pc.fill_null(pc.list_value_length(table[c]), 0), 0) for c in ("lines", "ends")])
            texts, lines, ends = (table[c].filter(some) for c in ("text", "lines", "ends"))
            line_doc, line_bounds, lines = _flat(lines)
            end_doc, end_bounds, ends = _flat(ends)
            counts, fields = [np.zeros(0, dtype=np.int64)], [[], [], []]
            for first, last, words in each(texts, "space"):
                part, part_ends = (slice(b[first], b[last]) for b in (line_bounds, end_bounds))
                doc = line_doc[part] - first
                begin = words.first[doc] + _field(lines, "place")[part]
                whole = [doc, begin, begin + _field(lines, "words")[part]]
                found = extended(words, end_doc[part_ends] - first, ends[part_ends])
                doc, begin, behind = (np.concatenate(x) for x in zip(whole, found, strict=True))
                order = np.lexsort((behind, begin, doc))
                doc, begin, behind = doc[order], begin[order], np.maximum.accumulate(behind[order])
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > behind[:-1])
                doc, begin, behind = doc[new], begin[new], behind[np.append(new[1:], True)[: len(new)]]
                letters = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
                base = letters[words.offsets[doc]]
                counts.append(np.bincount(doc, minlength=last - first))
                values = letters[words.starts[begin]] - base, letters[words.ends[behind - 1]] - base, behind - begin
                for out, value in zip(fields, values, strict=True):
                    out.append(value)
            every = np.zeros(len(batch), dtype=np.int64)
            every[np.flatnonzero(some.to_numpy(zero_copy_only=False))] = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([*[table[c] for c in others], _lists([every], fields, kind)], names=[*others, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*others).schema)
    return marked.mapInArrow(run, f"{schema}, spans array<struct<start:int,end:int,words:int>>")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_WORDS) -> DataFrame:
    """``row, start, end, words``: the spans to remove, as code points of the text."""
    marks = _marks(docs, min_words, min_line_words)
    marked = _keyed(docs).join(marks, "row").dropDuplicates(["row"]).select("row", "text", "lines", "ends")
    spans = _cut(marked, min_words).select("row", F.explode("spans").alias("span"))
    return spans.select("row", "span.start", "span.end", F.col("span.words").cast("long").alias("words"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_WORDS, each_row: bool = False) -> DataFrame:
    """``doc_id, n_removed, removed_words, removed, text`` for every row.

    ``removed`` lists the spans that were taken out as ``start:end`` in code points of the
    original text, joined by commas; ``text`` is what is left. A null text stays null, with
    nothing removed. With ``min_line_words=1`` every repeated line goes. Rows equal in ``doc_id``
    and text are one document, and each gets its result; with ``each_row`` all but one of them lose
    their whole text. A row without ``doc_id`` ranks last. An empty table gives an empty one.
    """
    marks = _marks(docs, min_words, min_line_words, each_row)
    own = _keyed(docs).join(marks, "row", "left")
    gone = F.lit(None).cast("long")
    if each_row:
        # rows of a key are all the same, so any of them may be the one that stays
        gone = F.when(F.row_number().over(Window.partitionBy("row").orderBy("row")) > 1, F.col("n"))
    own = own.withColumn("gone", gone)
    own = _cut(own.select("doc_id", "text", "gone", "lines", "ends"), min_words)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("gone").cast("int").alias("words")))
    own = own.withColumn("spans", F.when(F.col("gone").isNotNull(), whole).otherwise(F.col("spans")))
    removed_words = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    kept = F.expr(
        """array_join(transform(
             arrays_zip(concat(array(0), spans.end), concat(spans.start, array(length(text)))),
             x -> substring(text, x.`0` + 1, x.`1` - x.`0`)), '')"""
    )
    return own.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_removed"),
        removed_words.alias("removed_words"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(kept).alias("text"),
    )
