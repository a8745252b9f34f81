"""Words and word-sequence hashes of whole texts, computed for many documents at once.

Everything works on the UTF-8 bytes of an Arrow column. A word's hash is a polynomial in
random byte values modulo 2**64, taken from running sums, so no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_R = U64(0xD6E8FEB86659FD93)


def _class(words: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    if words == "space":  # [^\x20\x09-\x0D]+
        table[:] = True
        table[[9, 10, 11, 12, 13, 32]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


IS_WORD = {"space": _class("space"), "alnum": _class("alnum")}
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_IS_WORD_RAW = {kind: table[FOLD] for kind, table in IS_WORD.items()}
_BYTE_RAW = _BYTE[FOLD]
_buffers: list[np.ndarray] = []


def _scratch(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays used again by every chunk; only those of a long document are new."""
    if n > CHUNK_BYTES + 1:
        return np.empty(n, dtype=U64), np.empty(n, dtype=U64)
    if not _buffers or len(_buffers[0]) < n:
        _buffers[:] = [np.empty(CHUNK_BYTES + 1, dtype=U64) for _ in range(2)]
    return _buffers[0][:n], _buffers[1][:n]


_power = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _power[name] = np.multiply.accumulate(steps)
    return _power["up"][:n], _power["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``CHUNK_BYTES``."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, min(last, n)
        first = last


class Words:
    """Words of a range of documents: byte ranges, hashes, and each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str):
        base = int(offsets[0])
        raw = data[base : int(offsets[-1])]
        offsets = offsets - base
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        up, down = _powers(n + 1)
        inside = np.zeros(n + 2, dtype=bool)
        np.take(_IS_WORD_RAW[kind], raw, out=inside[1:-1])
        # a word ends where its document ends, also when the next one starts with a word
        change = inside[1:] != inside[:-1]
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        cut = cut[inside[cut] & inside[cut + 1]]
        change[cut] = True
        edges = np.flatnonzero(change)
        if len(cut):  # such a place is an end and a start
            edges = np.sort(np.concatenate([edges, cut]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        terms, sums = _scratch(n + 1)
        np.take(_BYTE_RAW, raw, out=terms[:n], mode="clip")
        np.multiply(terms[:n], up[:n], out=terms[:n])
        sums[0] = 0
        np.cumsum(terms[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one document."""
        n = len(self.hashes)
        total = np.zeros(max(0, n - size + 1), dtype=U64)
        for k in range(size):
            total = total * _R + self.hashes[k : k + len(total)]
        ok = np.ones(len(total), dtype=bool)
        for f in np.unique(self.first[1:-1]):
            ok[max(0, f - size + 1) : f] = False
        return mix(total + U64(size)), ok


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash that ``Words.shingles`` gives the whole sequence."""
    total = np.zeros(1, dtype=U64)
    for h in hashes:
        total = total * _R + h
    return mix(total + U64(len(hashes)))[0]


def each(column: pa.Array, kind: str) -> Iterator[tuple[int, int, Words]]:
    """Ranges of rows of a text column with their words."""
    data, offsets = utf8(column)
    for first, last in chunks(offsets):
        yield first, last, Words(data, offsets[first : last + 1], kind)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return x.astype(U64, copy=False).view(np.int64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(hashes) < 2:
        return hashes.copy()
    ordered = np.sort(hashes)
    keep = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]
