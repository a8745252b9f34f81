"""Periodic run detection: stretches of a text's words that repeat with a period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are the same), at
least ``max(LEAST, 2 * q)`` words long, that no neighbouring word extends. All runs are found, exactly:

* **Dyadic scales.** At scale ``s`` the words are cut into blocks of ``s``. A run whose period lies in
  ``2s - 1 .. 4s - 2`` holds a whole block, and the block again one period later.
* **Block convolution.** For each block, the sum of squared differences to the following window is taken
  at all of the scale's distances at once, by number-theoretic transforms modulo a prime. Words are numbers
  below the prime, so where the block occurs again the sum is exactly zero. A window longer than
  ``2 * WIDEST`` is taken in parts.
* **Seeds.** A zero is a block and a distance; the stretch around it with that distance is compared
  word by word, so a sum that is zero by chance costs time, never a wrong run. Distances are taken from the
  smallest on: a stretch whose period divides a distance explains that distance.

A block can only occur again if each of its words does, so blocks with a word that does not come again
within the scale's distances are not transformed; in plain prose, that is nearly all of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a run has at least.
LEAST = 12
#: Words of texts handled at once; a longer text is handled alone.
CHUNK_WORDS = 1 << 17
#: Largest block. Beyond it, windows grow in number and not in size.
WIDEST = 1 << 14
#: Numbers transformed at once.
TRANSFORMED = 1 << 19
#: 119 * 2**23 + 1, a prime with roots of unity for every power of two up to 2**23; 3 generates them all.
PRIME, ROOT = 998244353, 3

U64 = np.uint64
P = U64(PRIME)


@lru_cache(maxsize=32)
def _twiddles(n: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for the transform's levels, widest first."""
    levels, half = [], n // 2
    while half:
        root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        powers = np.ones(half, U64)
        step, done = root, 1
        while done < half:  # doubled: each pass fills as many as there are
            more = min(done, half - done)
            powers[done : done + more] = powers[:more] * U64(step) % P
            step, done = step * step % PRIME, done + more
        levels.append(powers)
        half //= 2
    return levels


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    count, n = rows.shape
    for powers in _twiddles(n, False):
        half = len(powers)
        x = rows.reshape(count, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.stack([(a + b) % P, (a + P - b) % P * powers % P], axis=2)
    return rows.reshape(count, n)


def inverse(rows: np.ndarray) -> np.ndarray:
    """Takes rows in bit-reversed order back."""
    count, n = rows.shape
    for powers in reversed(_twiddles(n, True)):
        half = len(powers)
        x = rows.reshape(count, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * powers % P
        rows = np.stack([(a + b) % P, (a + P - b) % P], axis=2)
    return rows.reshape(count, n) * U64(pow(n, -1, PRIME)) % P


def matches(values: np.ndarray, starts: np.ndarray, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (places in ``starts``) and distances ``first..last`` where a block's sum of squared differences is zero.

    ``values`` are numbers below ``PRIME``; there must be ``last + size`` of them behind every start.
    """
    width = last - first + size
    n = 1 << (width - 1).bit_length()
    blocks, distances = [], []
    step = max(1, TRANSFORMED // n)
    for k in range(0, len(starts), step):
        at = starts[k : k + step, None]
        block, window = values[at + np.arange(size)], values[at + first + np.arange(width)]
        x = np.zeros((len(at), n), U64)
        y = np.zeros((len(at), n), U64)
        x[:, :size], y[:, :width] = block[:, ::-1], window
        both = inverse(transform(x) * transform(y) % P)[:, size - 1 : width]
        squares = np.zeros((len(at), width + 1), U64)
        np.cumsum(window * window % P, axis=1, out=squares[:, 1:])
        own = (block * block % P).sum(axis=1)[:, None]
        # no wrap: each term is below 2**30 * width
        total = own + squares[:, size:] - squares[:, : width - size + 1] + U64(2) * (P - both)
        row, d = np.nonzero(total % P == 0)
        blocks.append(k + row)
        distances.append(first + d)
    return np.concatenate(blocks), np.concatenate(distances)


def _next_same(ids: np.ndarray) -> np.ndarray:
    """How far behind each word it stands again; the number of words if it doesn't."""
    order = np.argsort(ids, kind="stable")
    again = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return again


class _Runs:
    """Runs found so far: by period, their starts and ends, both ascending."""

    def __init__(self) -> None:
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def explained(self, starts: np.ndarray, ends: np.ndarray, period: int) -> np.ndarray:
        """Which stretches lie in a run whose period divides ``period``."""
        inside = np.zeros(len(starts), bool)
        for q, (first, last) in self.found.items():
            if period % q == 0:
                # runs of a period don't hold one another: the latest to start is the latest to end
                k = np.searchsorted(first, starts, "right") - 1
                inside |= (k >= 0) & (last[k] >= ends)
        return inside


def runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, end, period`` of all runs of several texts, by start and period.

    ``ids`` are the words of all texts as numbers below ``PRIME``, which no two texts share; ``bounds``
    are the places where texts begin, and the number of words.
    """
    n = len(ids)
    if n < least:
        return []
    again = _next_same(ids)
    # spread over the field, so that sums of squares are zero by chance no more often than 1 in PRIME
    values = (ids.astype(U64) * U64(636413622) + U64(144269504)) % P
    longest = int(np.diff(bounds).max())
    known = _Runs()
    # the first scale takes all periods below 7: runs of 12 words hold a block of 2 and its copy for each of them
    scale, first = 2, 1
    while 2 * first <= longest:
        last = 4 * scale - 2
        size = min(scale, WIDEST)
        starts = np.arange(0, n - size + 1, size)
        # every word of the block stands again at the distance, so none of its first repeats is further away
        far = again[: len(starts) * size].reshape(-1, size).max(axis=1)
        starts = starts[(far <= last) & (starts + size + first <= n)]
        seeds = []
        for low in range(first, last + 1, 2 * size):
            high = min(last, low + 2 * size - 1)
            padded = np.concatenate([values, np.zeros(high + size, U64)]) if len(starts) else values
            if len(starts):
                k, d = matches(padded, starts, size, low, high)
                seeds.append((starts[k], d))
        if seeds:
            place, distance = (np.concatenate(c) for c in zip(*seeds, strict=True))
            _extend(ids, bounds, place, distance, size, least, known)
        scale, first = 2 * scale, last + 1
    return sorted((s, e, q) for q, both in known.found.items() for s, e in zip(*(c.tolist() for c in both), strict=True))


def _extend(ids, bounds, place, distance, size, least, known: _Runs) -> None:
    """Adds the runs around the seeds of one scale, from the smallest distance on."""
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    heads = np.append(np.flatnonzero(np.diff(distance, prepend=-1)), len(distance))
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        d, at = int(distance[a]), place[a:b]
        at = at[~known.explained(at, at + d, d)]
        if not len(at):
            continue
        low = int(bounds[np.searchsorted(bounds, at[0], "right") - 1])
        high = int(bounds[np.searchsorted(bounds, at[-1], "right")])
        # words that differ from that d words on; the last d words of the texts differ from what follows by their numbers
        differ = np.flatnonzero(ids[low : high - d] != ids[low + d : high])
        edges = np.concatenate([[-1], differ, [max(high - d - low, 0)]])
        k = np.unique(np.searchsorted(edges, at - low, "right"))
        k = k[k < len(edges)]
        start, end = edges[k - 1] + 1 + low, edges[k] + low + d
        long = end - start >= max(least, 2 * d)
        start, end = start[long], end[long]
        new = ~known.explained(start, end, d)
        if new.any():
            known.found[d] = start[new], end[new]


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the query's contract makes periodic for a tenth of the ids."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def _chunks(batch: pa.RecordBatch, change) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, n = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        words = (text.as_py() or "").encode().split()  # splits at space and \t to \r alone
        if change:
            words = change(words, doc_id)
        if held and n + len(words) > CHUNK_WORDS:
            yield held
            held, n = [], 0
        held.append((doc_id, words))
        n += len(words)
    if held:
        yield held


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """``start, length, period`` of the runs of each text of words, by start and period."""
    ids, bounds, base = [], [0], 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids += [base + own.setdefault(w, len(own)) for w in words]
        base += len(own)
        bounds.append(len(ids))
    edges = np.array(bounds)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in runs(np.array(ids, np.int64), edges, least):
        k = int(np.searchsorted(edges, start, "right")) - 1
        found[k].append((start - bounds[k], end - start, q))
    return found


_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"
)


def collapse(docs: DataFrame, least: int = LEAST, change=None) -> DataFrame:
    """Each row's runs and its text with every run cut to its first period.

    ``doc_id, n_runs``; of the longest run (ties: smallest start, then period) ``start, length, period,
    exponent_milli``, null without a run; ``runs_sha256`` of all runs, ``collapsed_sha256`` and ``collapsed``, the
    words kept joined by one space; ``runs``. Words are runs of anything but ASCII white space. ``change`` maps a
    text's words and ``doc_id`` to the words to search. A null or empty text has no words and no runs; every row stands
    for itself, with or without ``doc_id``; an empty table gives an empty one. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ", 1)[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            for chunk in _chunks(batch, change):
                out: list[list] = [[] for _ in names]
                for (doc_id, words), found in zip(chunk, runs_of([w for _, w in chunk], least), strict=True):
                    if found:
                        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
                        best = [start, length, period, 1000 * length // period]
                        kept = np.ones(len(words), bool)
                        for s, e, q in found:
                            kept[s + q : s + e] = False
                        text = b" ".join([words[i] for i in np.flatnonzero(kept)])
                    else:
                        best, text = [None] * 4, b" ".join(words)
                    listed = "".join(f"{s},{e},{q}\n" for s, e, q in found)
                    row = [doc_id, len(found), *best, _hex(listed.encode()), _hex(text), text.decode()]
                    for column, value in zip(out, [*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]], strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 6 + [pa.string()] * 3
                kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, _SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    """The query's digests of :func:`collapse`, on texts of which a tenth have a tail made periodic."""
    return collapse(docs, change=made_periodic).drop("collapsed", "runs")
