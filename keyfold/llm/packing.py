"""Best-fit packing: documents as tokens, placed into sequences by the sum-of-squares rule.

Every document becomes its token ids and an end token. Only documents longer than a sequence
are cut. What is shorter than a sequence is an item; an item goes to the place that makes the
sum of squares of N(g), the number of open sequences with g tokens left, smallest: into a
sequence with gap g the sum changes by 2 * (N(g - size) - N(g) + 1), into a new one by
2 * N(capacity - size) + 1. Ties go to the smallest gap. The items of sequences that
stay open are placed once more where they fit best.

Items are packed in blocks of bounded size, each in one task. The items of the sequences that blocks
leave open are packed again in other blocks; when that closes few more, the open sequences are items themselves
and are packed until one block holds all that is left.
Nothing is gathered on the driver, and no task sees more than a block.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored
from keyfold.llm._words import each

CAPACITY = 2048
#: Items packed by one task. More make fuller sequences; the last rounds join what is left.
BLOCK_ITEMS = 50_000
#: Words whose ids a Python worker keeps; beyond it, the cache starts anew.
CACHE_WORDS = 500_000
#: A sequence with less than this part of its capacity left counts as closed.
SLACK = 256
END_ID = 0


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts by a byte-pair tokenizer with word ends, as packed 32-bit integers.

    No token spans white space, so each distinct piece between blanks, by its hash, is
    tokenized once while it stays in the cache. Pieces of common letters go through the same
    merges as ranks, with a blank as the end of a word; a rank merges by the joined bytes, a
    rule by its two parts. Both agree if every rule's parts are what its bytes reach on their
    own, which ``rules_agree`` checks. All other pieces go to the tokenizer itself.
    """

    PLAIN = regex.compile("[\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]+")
    PLAIN_LINES = regex.compile("[\\n\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]+")
    SPLIT = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            json_ = json.load(f)
        model = json_["model"]
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            word_end = token.endswith("</w>")
            return bytes(letters[c] for c in token.removesuffix("</w>")) + b" " * word_end

        self.rules = [tuple(raw(part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        tokens = [bytes([b]) for b in range(256)] + [bytes([b, 32]) for b in range(256) if b != 32]
        tokens += [left + right for left, right in self.rules]
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        ids = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.id_of_rank = np.array([ids.get(token, 0) for token in tokens], dtype="<u4")
        self.border = self.ranks[b"\n "]
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})
        # the tokenizer finds these in the text as it is, before it folds letters
        self.special = [t["content"].encode() for t in json_.get("added_tokens", [])]
        self.agree = self.rules_agree()
        self.cache: dict[int, bytes] = {}

    def rules_agree(self) -> bool:
        """Whether merging by ranks gives what merging by rules gives, for any text."""
        if len(self.ranks) != 511 + len(self.rules):
            return False
        for left, right in self.rules:
            own = self.ranks[left + right]
            word = left + right
            parts = [word[k : k + 1] for k in range(len(word))]
            if word.endswith(b" "):
                parts[-2:] = [word[-2:]]
            while len(parts) > 2:
                found = [self.ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
                k = found.index(min(found))
                if found[k] >= own:
                    return False
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if parts != [left, right]:
                return False
        return True

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: dict[int, str]) -> None:
        plain, cache = words, self.cache
        joined = "\n".join(words.values())
        if not self.agree or not self.PLAIN_LINES.fullmatch(joined):
            plain = {h: w for h, w in words.items() if self.agree and self.PLAIN.fullmatch(w)}
            for h in words.keys() - plain.keys():
                cache[h] = self._direct(words[h])
            joined = "\n".join(plain.values())
        if plain:
            split = " ".join(self.SPLIT.findall(joined.lower()))
            ranks = np.array(self.merges.encode_ordinary(split + " \n "), dtype=np.int64)
            ends = np.flatnonzero(ranks == self.border).tolist()
            packed = self.id_of_rank[ranks].tobytes()
            first = 0
            for h, end in zip(plain, ends, strict=True):
                cache[h] = packed[4 * first : 4 * end]
                first = end + 1

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        for first, last, words in each(column, "space"):
            raw = words.raw.tobytes()
            special = any(s in raw for s in self.special)
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            cache = self.cache
            values, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            values = values.tolist()
            new = {
                h: raw[words.starts[k] : words.ends[k]].decode()
                for h, k in zip(values, at.tolist(), strict=True)
                if h not in cache
            }
            if new:
                self._learn(new)
            parts = [cache[h] for h in values]
            flat = np.frombuffer(b"".join(parts), dtype="<u4")
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
            starts = np.cumsum(sizes) - sizes
            lengths = sizes[inverse]
            place = np.concatenate([[0], np.cumsum(lengths)])
            ids = flat[np.repeat(starts[inverse] - place[:-1], lengths) + np.arange(place[-1])].tobytes()
            bounds = (4 * place[words.first]).tolist()
            for d in range(last - first):
                text = raw[words.offsets[d] : words.offsets[d + 1]] if special else b""
                if any(s in text for s in self.special):
                    yield self._direct(text.decode())
                else:
                    yield ids[bounds[d] : bounds[d + 1]]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: ``doc_id, piece, start, length, ids_crc32``.

    A null text is empty, which leaves the end token alone. Rows with the same ``doc_id``
    are separate documents. Whole texts are read; no ids are kept beyond a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers.get(tokenizer_path)
        if own is None:
            own = _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                ids += end
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    own_ids = ids[first : first + 4 * capacity]
                    out.append((doc_id, k, first // 4, len(own_ids) // 4, zlib.crc32(own_ids)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each item, and the fill of every sequence.

    Items are taken from the largest to the smallest, equal ones in the order given.
    """
    sequence = np.zeros(len(sizes), dtype=np.int64)
    offset = np.zeros(len(sizes), dtype=np.int64)
    open_count = np.zeros(capacity + 1, dtype=np.int64)  # by gap; full ones don't count
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    far = np.int64(1) << 60
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        gap = capacity
        if size < capacity:
            here = open_count[size:capacity]
            after = open_count[0 : capacity - size]
            change = np.where(here > 0, 2 * (after - here + 1), far)
            if here[0] > 0:  # fits exactly; a full sequence no longer counts
                change[0] = 1 - 2 * here[0]
            best = int(np.argmin(change)) if len(change) else 0
            if len(change) and change[best] <= 2 * open_count[capacity - size] + 1:
                gap = size + best
        if gap == capacity:
            number = len(fills)
            fills.append(0)
        else:
            number = members[gap].pop()
            open_count[gap] -= 1
        sequence[k], offset[k] = number, fills[number]
        fills[number] += size
        left = capacity - fills[number]
        if left:
            members[left].append(number)
            open_count[left] += 1
    return sequence, offset, np.array(fills, dtype=np.int64)


def place_open_again(
    sizes: np.ndarray, sequence: np.ndarray, offset: np.ndarray, fills: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the items of sequences that stayed open placed anew.

    The rule keeps sequences of many gaps open for items to come. When none come, their items
    go, largest first, where they fit best, which closes nearly all. Kept only if it saves a sequence.
    """
    again = np.flatnonzero(fills[sequence] < capacity)
    sequence, offset = sequence.copy(), offset.copy()
    open_count = np.zeros(capacity + 1, dtype=np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    more: list[int] = []
    before = (sequence.copy(), offset.copy(), fills)
    for k in again[np.argsort(-sizes[again], kind="stable")]:
        size = int(sizes[k])
        fitting = np.flatnonzero(open_count[size:])
        if len(fitting):
            gap = size + int(fitting[0])
            number = members[gap].pop()
            open_count[gap] -= 1
        else:
            number = len(more)
            more.append(0)
        sequence[k], offset[k] = len(fills) + number, more[number]
        more[number] += size
        left = capacity - more[number]
        if left:
            members[left].append(number)
            open_count[left] += 1
    if len(more) >= np.count_nonzero(fills < capacity):
        return before
    return sequence, offset, np.concatenate([fills, np.array(more, dtype=np.int64)])


def _pack_blocks(items: DataFrame, capacity: int, base: int, items_per_block: int) -> tuple[DataFrame, int]:
    """Items ``item, size`` packed in blocks; ``item, size, number, inner, fill`` and the block count."""
    blocks = max(1, math.ceil(items.count() / items_per_block))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("item", kind="stable")
        sizes = block["size"].to_numpy()
        number, inner, fills = place_open_again(sizes, *sum_of_squares(sizes, capacity), capacity)
        # the number holds round and block, so that it is the same whenever the task runs
        top = np.int64(base) + np.int64(block["block"].iloc[0])
        return pd.DataFrame(
            {"item": block["item"], "size": sizes, "number": (top << 24) + number, "inner": inner, "fill": fills[number]}
        )

    packed = (
        items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(base)), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(run, "item string, size long, number long, inner long, fill long")
    )
    return packed, blocks


def pack(cut: DataFrame, capacity: int = CAPACITY, items_per_block: int = BLOCK_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    Sequences are gapless from 0. An empty table gives an empty one. Pieces that are equal in
    every column, as those of repeated rows, are placed one by one.
    """
    cut = stored(
        cut.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.monotonically_increasing_id().cast("string").alias("_item"),
        ),
        "pieces",
    )
    full = F.col("length") >= capacity
    items = cut.where(~full).select(F.col("_item").alias("item"), F.col("length").alias("size"))
    # items of sequences that a block leaves open are dealt to other blocks, as long as that closes a good part of them
    parts, base, n = [], 1, items.count()
    while True:
        packed, blocks = _pack_blocks(items, capacity, base, items_per_block)
        packed, base = stored(packed, "packed"), base + blocks
        is_open = F.col("fill") + capacity // SLACK < capacity
        left = packed.where(is_open).count() if blocks > 1 else 0
        if not left or 10 * left > 9 * n:
            break
        parts.append(packed.where(~is_open))
        items, n = packed.where(is_open).select("item", "size"), left
    placed = reduce(DataFrame.unionByName, [*parts, packed]).select(
        F.col("item").alias("_item"), "number", F.col("inner").alias("offset"), "fill"
    )
    # what is open then is packed as it is, until one block holds it all
    last = 0
    while blocks > 1 and blocks != last:
        last, placed = blocks, stored(placed, "placed")
        items = (
            placed.where(F.col("fill") < capacity)
            .select(F.col("number").cast("string").alias("item"), F.col("fill").alias("size"))
            .distinct()
        )
        packed, blocks = _pack_blocks(items, capacity, base, items_per_block)
        base += blocks
        moved = stored(packed, "packed").select(
            F.col("item").cast("long").alias("number"), F.col("number").alias("_to"), "inner", F.col("fill").alias("_fill")
        )
        placed = (
            placed.join(moved, "number", "left")
            .select(
                "_item",
                F.coalesce("_to", "number").alias("number"),
                (F.col("offset") + F.coalesce("inner", F.lit(0))).alias("offset"),
                F.coalesce("_fill", "fill").alias("fill"),
            )
        )
    small = cut.where(~full).join(placed.select("_item", "number", "offset"), "_item")
    whole = cut.where(full).withColumns(
        {"number": -F.abs(F.xxhash64("_item")) - 1, "offset": F.lit(0).cast("long")}
    )
    return small.unionByName(whole).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset"
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, items_per_block: int = BLOCK_ITEMS
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that hold them.

    A null or empty text is one piece, its end token. Rows that repeat or have no ``doc_id`` are documents of their
    own; other columns are not looked at; an empty table gives an empty one. The same files give the same sequences.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity, items_per_block)
