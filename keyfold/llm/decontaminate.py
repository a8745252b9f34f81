"""Benchmark decontamination: a prefix-filtered set join with exact windows.

Every window of a benchmark item (``WINDOW`` consecutive words; a shorter item is one window)
is a set of shingles that a document has to hold in full. For such a containment the necessary
prefix is one shingle; the rarest one in the corpus makes the fewest candidates. So the
benchmark's shingles are counted in all documents, every window is filed under its rarest
shingle, and documents are joined on it. A candidate lies in the document at the place that
the shingle's place in the window gives; windows that would begin before the text or end behind
it are dropped, and the others are compared word by word.

Nothing that grows is broadcast: a bit map of fixed size says which shingles of a document
can be a benchmark's at all, and only those are joined. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored
from keyfold.llm._words import Words, each, sequence_hash, signed

WINDOW = 10
SHINGLE = 5
#: Bits of the map of benchmark shingles: 2 MB at any size of the benchmark.
MARKS = 1 << 24
#: A common shingle's occurrences meet its windows in this many groups.
SALTS = 8


def _of(words: Words, d: int) -> np.ndarray:
    return words.hashes[words.first[d] : words.first[d + 1]]


def _shingles(own: np.ndarray, size: int) -> list[int]:
    return [int(sequence_hash(own[k : k + size]).view(np.int64)) for k in range(len(own) - size + 1)]


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, words, tokens``: distinct windows of each item with their shingles in order.

    Items without words (also null ones) have no window. A window shorter than a shingle has
    its whole sequence as its only shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, tokens = [], [], []
            for first, last, words in each(batch.column(1), "alnum"):
                for d in range(last - first):
                    own = _of(words, d)
                    length = min(window, len(own))
                    seen = set()
                    for k in range(len(own) - length + 1 if length else 0):
                        part = own[k : k + length]
                        if (key := part.tobytes()) not in seen:
                            seen.add(key)
                            ids.append(batch.column(0)[first + d].as_py())
                            out.append(signed(part).tolist())
                            tokens.append(_shingles(part, min(shingle, length)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
                names=["item_id", "words", "tokens"],
            )

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "item_id string, words array<long>, tokens array<long>"
    )


def _bits(tokens: DataFrame) -> np.ndarray:
    """A bit map of the ``token`` column; a fixed size."""
    place = F.pmod("token", F.lit(MARKS))
    blocks = (
        tokens.select(F.shiftright(place, 12).alias("block"), (place % 4096).alias("bit"))
        .groupBy("block")
        .agg(F.collect_set("bit").alias("bits"))
    )
    found = np.zeros(MARKS, dtype=bool)
    for row in blocks.collect():
        found[(row["block"] << 12) + np.array(row["bits"], dtype=np.int64)] = True
    return np.packbits(found)


def _marked(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    place = (tokens & np.uint64(MARKS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _hits(words: Words, bits: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word place, token and size of the shingles that the bit map lets through."""
    places, tokens, lengths = [], [], []
    for size in sizes:
        found, ok = words.shingles(size)
        at = np.flatnonzero(_marked(bits, found) & ok)
        places.append(at)
        tokens.append(found[at])
        lengths.append(np.full(len(at), size))
    return np.concatenate(places), np.concatenate(tokens), np.concatenate(lengths)


def _text(docs: DataFrame, key: str | None = None) -> DataFrame:
    row = F.col(key).cast("string") if key else F.expr("uuid()")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))


def _counted(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """``token, n``: occurrences of shingles that may be the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in each(batch.column(1), "alnum"):
                _, tokens, _ = _hits(words, bits.value, sizes)
                if len(tokens):
                    own, n = np.unique(tokens, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(n)], names=["token", "n"])

    return _text(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bits, sizes: list[int], window: int, key: str | None = None) -> DataFrame:
    """Every row with its word count and its candidate places.

    ``around`` holds the hashes of the words from ``pos - left`` on, as many as a window that
    holds the shingle at ``pos`` can reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for first, last, words in each(batch.column(1), "alnum"):
                counts[first:last] = np.diff(words.first)
                places, tokens, lengths = _hits(words, bits.value, sizes)
                docs_of = np.searchsorted(words.first, places, "right") - 1
                for d, at, token, size in zip(docs_of.tolist(), places.tolist(), signed(tokens).tolist(), lengths.tolist(), strict=True):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    left = max(a, at - window + size)
                    hits[first + d].append(
                        {
                            "token": token, "pos": at - a, "left": at - left,
                            "around": signed(words.hashes[left : min(b, at + window)]).tolist(),
                        }
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(counts), pa.array(hits, _HITS)],
                names=["row", "doc_id", "n_words", "hits"],
            )

    return _text(docs, key).mapInArrow(
        run,
        "row string, doc_id long, n_words long, hits array<struct<token:long,pos:long,left:long,around:array<long>>>",
    )


_HITS = pa.list_(
    pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("left", pa.int64()), ("around", pa.list_(pa.int64()))])
)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, key: str | None = None
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row.

    A null text has no words. An item without words or id is in no document's list (one with a
    null id still marks words). Rows that repeat a ``doc_id`` or have none are rows of their own;
    items with the same id count once. A column ``key`` of ``docs`` that is unique and stored is
    given too, so that a row can be told apart from others of its ``doc_id``. Empty tables: no documents give no rows, no items no hits.
    """
    spark = docs.sparkSession
    all_windows = stored(windows(items, window, shingle), "windows")
    listed = all_windows.select("item_id", "words", F.posexplode("tokens").alias("offset", "token"))
    sizes = [
        r["size"]
        for r in all_windows.select(F.least(F.size("words"), F.lit(shingle)).alias("size")).distinct().collect()
    ] or [shingle]
    every = spark.sparkContext.broadcast(_bits(listed.select("token").distinct()))
    counts = _counted(docs, every, sizes)
    per_window = all_windows.select("words", "tokens").distinct().select("words", F.posexplode("tokens").alias("offset", "token"))
    rarest = stored(
        per_window.join(counts, "token", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("first"))
        .where("first.n > 0")  # a window with a shingle that no document has is nowhere
        .select("words", F.col("first.token").alias("token"), F.col("first.offset").alias("offset")),
        "prefixes",
    )
    marks = spark.sparkContext.broadcast(_bits(rarest.select("token").distinct()))
    own = stored(_candidates(docs, marks, sizes, window, key), "candidates")
    found = own.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    length = F.size("words")
    verified = (
        found.withColumn("salt", F.pmod(F.hash("row", "pos"), F.lit(SALTS)))
        .join(rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
        # the window begins in the text, ends in it, and is there word by word
        .where((F.col("offset") <= F.col("left")) & (F.col("left") - F.col("offset") + length <= F.size("around")))
        .where(F.slice("around", (F.col("left") - F.col("offset") + 1).cast("int"), length) == F.col("words"))
        .select("row", (F.col("pos") - F.col("offset")).alias("start"), "words")
    )
    verified = stored(verified, "hits")
    covered = verified.groupBy("row").agg(
        F.size(
            F.array_distinct(
                F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.size("words") - 1)))
            )
        ).cast("long").alias("n_hit")
    )
    words_key = F.xxhash64("words")
    held = (
        verified.select("row", "words").distinct()
        .withColumns({"key": words_key, "salt": F.pmod(F.hash("row"), F.lit(SALTS))})
        .join(
            all_windows.select("item_id", F.col("words").alias("_words")).withColumns(
                {"key": F.xxhash64("_words"), "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))}
            ),
            ["key", "salt"],
        )
        .where(F.col("words") == F.col("_words"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    return (
        own.select("row", "doc_id", "n_words")
        .join(covered.join(held, "row", "left"), "row", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            *([F.col("row").cast(docs.schema[key].dataType).alias(key)] if key else []),
        )
    )


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(table: str, key: str) -> str:
        return (
            f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),"
            f" '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
        )

    return f"""
WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "item_id")}),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') AS g FROM
  (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, k, array_to_string(w[k + 1 : k + n], ' ') AS g FROM
  (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, k, n, item_id FROM p JOIN v USING (n, g)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)"""
