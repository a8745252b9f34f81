"""Document fingerprints: invertible Bloom lookup sketches of a text's passages.

A passage is a line, cut further behind words whose hash ends in zeros, about every ``CUT`` words, so
that an edit only changes the passages it touches. A passage's digest is a 64-bit hash of its words; the
second time a text has it, it counts as another one. White space within lines doesn't count.

Every digest is put into three cells; a cell holds the number, the exclusive or, and the exclusive or of a
check value of what is in it. Cells of two versions **subtract**: what both have cancels out. A
cell that is left with one digest gives it away, and taking it out of its other cells frees more
(**peeling**), until the digests that differ are recovered. If cells are left over, the two are **compared
again with larger sketches**, made from the digests, until all is recovered.

The fingerprint is the smallest sketch and the number of digests. The likeness of two versions is the
share of common digests among all, which the recovered ones give.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm._store import stored
from keyfold.llm._words import Words, _powers, each, mix

U64 = np.uint64
#: Words of a passage on average.
CUT = 8
#: Cells of the fingerprint, and by how much they grow when peeling fails; three equal parts.
CELLS, GROWTH = 24, 4
#: Characters of a piece of the ordered table, which one task handles, and pieces at most.
PIECE_CHARS, MOST_PIECES = 1 << 22, 1 << 16
#: Rows drawn for each cut between pieces.
DRAWN = 32
#: Characters compared at once.
CHUNK_CHARS = 1 << 20

_SEEDS = mix(np.arange(1, 4, dtype=U64) * U64(0x9E3779B97F4A7C15))
_CHECK = U64(0xC2B2AE3D27D4EB4F)
_AGAIN = U64(0xD6E8FEB86659FD93)


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the passages of a range of texts, and where each text's begin."""
    n = len(words.hashes)
    if not n:
        return np.zeros(0, U64), np.zeros(len(words.first), np.int64)
    lines = np.concatenate([[0], np.cumsum(words.raw == 10)])
    ends = words.hashes % U64(CUT) == 0
    ends[:-1] |= lines[words.starts[1:]] != lines[words.ends[:-1]]
    last = words.first[1:] - 1
    ends[last[last >= 0]] = True
    ends[-1] = True
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words.hashes * up[:n])])
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64))
    bounds = np.searchsorted(start, words.first)
    # the k-th passage of a kind in a text is one of its own
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    return np.where(nth > 0, mix(h + nth.astype(U64) * _AGAIN), h), bounds


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passage digests of texts, one after the other, and where each text's begin and end."""
    parts, bounds, total = [], [np.zeros(1, np.int64)], 0
    for _, _, words in each(pa.array(texts, pa.large_string()), "space"):
        own, first = _digests(words)
        parts.append(own)
        bounds.append(first[1:] + total)
        total += len(own)
    return np.concatenate([np.zeros(0, U64), *parts]), np.concatenate(bounds)


class Sketches:
    """Sketches of one size for several texts, as flat arrays of cells."""

    def __init__(self, count: int, cells: int, level: int = 0):
        self.cells, self.level = cells, U64(level)
        self.number = np.zeros(count * cells, np.int64)
        self.sum, self.check = np.zeros(count * cells, U64), np.zeros(count * cells, U64)

    def add(self, text: np.ndarray, digest: np.ndarray, times: np.ndarray | int = 1) -> None:
        """Puts digests into the sketches of their texts, or takes them out (``times`` -1)."""
        part = self.cells // 3
        check = mix(digest ^ _CHECK) >> U64(32)
        for k, seed in enumerate(_SEEDS):
            place = (mix(digest + seed + (self.level << U64(8))) >> U64(32)) * U64(part) >> U64(32)
            at = text * self.cells + k * part + place.astype(np.int64)
            np.add.at(self.number, at, times)
            np.bitwise_xor.at(self.sum, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def subtract(self, other: Sketches) -> Sketches:
        """What this has beyond the other (number 1), and the other beyond this (-1)."""
        left = Sketches(0, self.cells, int(self.level))
        left.number = self.number - other.number
        left.sum, left.check = self.sum ^ other.sum, self.check ^ other.check
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests: their text, digest and sign; and which texts are recovered whole. Empties the cells."""
        texts, found, signs = [], [], []
        # every round frees a digest of each text that is not stuck; more rounds than cells mean a false one
        for _ in range(2 * self.cells):
            at = np.flatnonzero((np.abs(self.number) == 1) & (mix(self.sum ^ _CHECK) >> U64(32) == self.check))
            if not len(at):
                break
            text, digest, sign = at // self.cells, self.sum[at], self.number[at]
            order = np.lexsort((digest, text))
            text, digest, sign = text[order], digest[order], sign[order]
            once = np.ones(len(at), bool)
            once[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
            text, digest, sign = text[once], digest[once], sign[once]
            self.add(text, digest, -sign)
            texts.append(text)
            found.append(digest)
            signs.append(sign)
        empty = (self.number == 0) & (self.sum == 0)
        whole = empty.reshape(-1, self.cells).all(axis=1)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *texts]), np.concatenate([np.zeros(0, U64), *found]), np.concatenate([none, *signs]), whole

    def encoded(self, counts: np.ndarray) -> list[str]:
        """Every text's sketch as base64 of its number of digests and its cells, little-endian."""
        cells = np.zeros(len(self.number), np.dtype([("number", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
        cells["number"], cells["sum"], cells["check"] = self.number, self.sum, self.check
        data, size = cells.tobytes(), cells.itemsize * self.cells
        return [
            base64.b64encode(int(n).to_bytes(4, "little") + data[k * size : (k + 1) * size]).decode() for k, n in enumerate(counts)
        ]


def sketches(digest: np.ndarray, bounds: np.ndarray, cells: int = CELLS) -> Sketches:
    made = Sketches(len(bounds) - 1, cells)
    made.add(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), digest)
    return made


def _chosen(digest: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some texts, and which of these each belongs to."""
    sizes = np.diff(bounds)[texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return digest[bounds[texts][owner] + inside], owner


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], left: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The passages that differ between pairs of versions: pair, digest, and 1 if only the first has it, else -1.

    ``a`` and ``b`` are :func:`digests` of the versions, ``left`` their subtracted sketches. Pairs that
    don't peel are compared again with ``GROWTH`` times as many cells, other places for each digest, until they do.
    """
    pairs = np.arange(len(a[1]) - 1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cells, level = left.cells, 0
    while True:
        pair, digest, sign, whole = left.peel()
        good = whole[pair]
        out.append((pairs[pair[good]], digest[good], sign[good]))
        pairs = pairs[~whole]
        if not len(pairs):
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))
        cells, level = cells * GROWTH, level + 1
        left = Sketches(len(pairs), cells, level)
        for version, times in ((a, 1), (b, -1)):
            own, owner = _chosen(*version, pairs)
            left.add(owner, own, times)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], left: Sketches) -> np.ndarray:
    """The share of common passages among all of each pair of versions; 1 if neither has any."""
    pair, _, _ = differing(a, b, left)
    apart = np.bincount(pair, minlength=len(a[1]) - 1)
    both = (np.diff(a[1]) + np.diff(b[1]) - apart) // 2
    return np.where(apart == 0, 1.0, both / np.maximum(both + apart, 1))


def _rows(docs: DataFrame) -> tuple[list[Column], DataFrame]:
    """The order of rows: descending ``doc_id``, none last, then a hash of the text; and the rows with it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("h")]
    return order, own


def _pieces(spark: SparkSession, keys: DataFrame) -> tuple[list[tuple], dict[tuple, int]]:
    """Cuts between pieces of the order, and for the first key of each piece, the piece before it that has rows.

    Drawn rows only set how large pieces are. The piece before the first is the last.
    """
    rows, chars = keys.agg(F.count(F.lit(1)), F.sum("chars")).first()
    if not rows:
        return [], {}
    parts = min(MOST_PIECES, 1 + (chars or 0) // PIECE_CHARS)
    share = min(1.0, parts * DRAWN / rows)
    drawn = keys.where(F.xxhash64("none", "down", "h").bitwiseAND(2**31 - 1) < int(2**31 * share)).select("none", "down", "h")
    values = sorted(tuple(r) for r in drawn.collect())
    at = (round(k * len(values) / parts) for k in range(1, parts))
    cuts = sorted({values[k] for k in at if k < len(values)})

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = bisect_right(cuts, key)
                if piece not in first or key < first[piece]:
                    first[piece] = key
        if first:
            columns = [list(first), *zip(*first.values(), strict=True)]
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["piece", "none", "down", "h"])

    firsts = (
        keys.select("none", "down", "h")
        .mapInArrow(first_keys, "piece int, none boolean, down long, h long")
        .groupBy("piece")
        .agg(F.min(F.struct("none", "down", "h")).alias("key"))
        .collect()  # one row a piece
    )
    firsts = sorted((r["piece"], tuple(r["key"])) for r in firsts)
    return cuts, {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in pieces of the order, ready to be read by :func:`_paired`.

    ``piece, guest, none, down, h, doc_id, text, copies``. The first row of a piece is also the guest behind the last row of the piece
    before. Rows of a batch that are equal in id and text travel as one, with their number.
    """
    spark = docs.sparkSession
    order, own = _rows(docs)
    keys = stored(own.select(*order, F.length("text").cast("long").alias("chars")), "sketch-keys")
    cuts, before = _pieces(spark, keys)
    schema = "piece int, guest boolean, none boolean, down long, h long, doc_id long, text string, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                copies.setdefault(key, [row, 0])[1] += 1
            taken, pieces, guests, times = [], [], [], []
            for key, (row, n) in copies.items():
                taken.append(row)
                pieces.append(bisect_right(cuts, key))
                guests.append(False)
                times.append(n)
                if key in before:
                    taken.append(row)
                    pieces.append(before[key])
                    guests.append(True)
                    times.append(1)
            if taken:
                rest = batch.take(pa.array(taken, pa.int64()))
                columns = [pa.array(pieces, pa.int32()), pa.array(guests, pa.bool_()), *rest.columns, pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    dealt = own.select(*order, "doc_id", "text").mapInArrow(run, schema)
    return dealt.repartition("piece").sortWithinPartitions("piece", "guest", "none", "down", "h")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str, int]]:
    """Id, text, the next row's text, and how many rows that stands for."""
    held = None
    for batch in batches:
        piece, guest, doc_id, text, copies = (batch.column(k).to_pylist() for k in (0, 1, 5, 6, 7))
        for row in zip(piece, guest, doc_id, text, copies, strict=True):
            if held is not None and held[0] == row[0]:
                if not held[1]:
                    yield held[2], held[3], row[3], 1
                elif row[1]:
                    continue  # the guest once more
            held = row
            if not row[1] and row[4] > 1:
                yield row[2], row[3], row[3], row[4] - 1


def _hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _compared(rows: list[tuple[int | None, str, str, int]]) -> pa.RecordBatch:
    ids, texts, following, times = zip(*rows, strict=True)
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    own, new, after = (digests(list(c)) for c in (texts, edited, following))
    a, b, c = (sketches(*d) for d in (own, new, after))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([_hashed(t) for t in edited]),
        pa.array(a.encoded(np.diff(own[1]))),
        pa.array(b.encoded(np.diff(new[1]))),
        pa.array(likeness(own, new, a.subtract(b))),
        pa.array(likeness(own, after, a.subtract(c))),
        pa.array(times, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, times long"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first as many, or all, of
    the next row in descending ``doc_id``; rows without an id come last, rows that repeat an id stand in the order
    of a hash of their texts, and after the last comes the first. A null text is empty; two empty texts have
    likeness 1. Other columns are not looked at; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in _paired(batches):
            held.append(row)
            chars += len(row[1]) + len(row[2])
            if chars > CHUNK_CHARS:
                yield _compared(held)
                held, chars = [], 0
        if held:
            yield _compared(held)

    found = with_next(docs).mapInArrow(run, _SCHEMA)
    return found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_", "times")
