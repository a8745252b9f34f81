"""Personal data: base rules, and spans that a character-level BiLSTM-CRF adds to them.

The tagger is trained on windows around the spans that the base rules label in a bounded sample
of documents, as they are and rewritten in other usual ways (other separators, no country
code, blanks around ``@``). It reads overlapping windows of whole texts. All its kinds need a
digit or ``@``, and a span without one is dropped, so windows without any are not read.
Windows reach ``STRIDE`` characters beyond every digit and ``@``, and on while a span touches the
last border. Parts of a span that a border cuts are joined with what the neighbouring window
found there; of all spans of a document, those that don't overlap and have the highest sum of scores stay. A span
of the tagger must be plausible (enough digits, a valid check digit, parts in range) and must not
touch a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm._tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
WINDOW = 80
STRIDE = 40
#: Least mean probability of a span's tags.
MIN_SCORE = 0.9
#: Bounds of the training sample.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 10_000
SAMPLE_WINDOWS = 800
EPOCHS = 14

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is read from its first one on: from any other the result is the same
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """Spans of the base rules by start, then kind; in time linear in the text.

    An email is found from its ``@``: its domain ahead, and its local part back to the end of the
    match before. Without ``checked``, a card needs no valid check digit: letters can't show it,
    so the tagger learns what looks like a card, and the digit is checked on what it finds.
    """
    found: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            found.append(("email", start, m.end()))
            last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and (luhn(digits) or not checked):
                    found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that cover every digit and ``@`` with ``STRIDE`` characters to both sides."""
    out: list[tuple[int, int]] = []
    covered = -1
    for m in _ANCHOR.finditer(text):
        at = m.start()
        if at + STRIDE < covered:
            continue
        start = max(0, at - STRIDE) if covered < at - STRIDE else covered - (WINDOW - STRIDE)
        while covered <= at + STRIDE and covered < len(text):
            out.append((start, min(len(text), start + WINDOW)))
            covered = start + WINDOW
            start += STRIDE
    return out


def _matrix(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), WINDOW), dtype=np.int64)
    for k, text in enumerate(texts):
        rows[k, : len(text)] = symbols(text)
    return rows


def _plausible(kind: str, part: str) -> bool:
    digits = "".join(_DIGIT.findall(part))
    if kind == "email":
        return part.count("@") == 1 and "." in part[part.index("@") :] and part.index("@") > 0
    if kind == "ip":
        numbers = re.findall("[0-9]+", part)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _rewritten(kind: str, part: str, rng: np.random.Generator) -> str:
    """The same datum written in another usual way."""
    digits = "".join(_DIGIT.findall(part))
    if kind == "email":
        return [part.replace("@", " @ "), part.replace("@", "@ "), part.upper(), part.replace(".", "_", 1)][rng.integers(4)]
    if kind == "ip":
        return part.replace(".", [" . ", ". ", "-"][rng.integers(3)])
    if kind == "card":
        mark = [" ", "-", ".", "/"][rng.integers(4)]
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    own = digits[-10:]
    return [
        f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"00{digits[0]} {own[:3]} {own[3:]}",
        f"{own[:3]}.{own[3:6]}.{own[6:]}", f"{own[:3]} {own[3:6]} {own[6:8]} {own[8:]}",
    ][rng.integers(5)]


def fit(texts: list[str], windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger from the spans that the base rules label; none if they label nothing."""
    rng = np.random.default_rng(3)
    parts: list[str] = []
    tags: list[np.ndarray] = []
    labelled = 0
    for text in texts:
        spans = base_spans(text, checked=False)
        versions = [(text, spans)]
        if spans:
            # a copy with every datum rewritten, or kept, at random
            out, moved, at = [], [], 0
            size = 0
            for kind, start, end in spans:
                if start < at:
                    continue
                own = text[start:end] if rng.random() < 0.25 else _rewritten(kind, text[start:end], rng)
                out += [text[at:start], own]
                size += start - at
                moved.append((kind, size, size + len(own)))
                size += len(own)
                at = end
            versions.append(("".join(out) + text[at:], moved))
        for own_text, own_spans in versions:
            tag = np.zeros(len(own_text), dtype=np.int64)
            for kind, start, end in own_spans:
                k = 1 + 2 * KINDS.index(kind)
                tag[start:end], tag[start] = k + 1, k
            for start, end in _windows(own_text):
                shift = int(rng.integers(0, STRIDE // 2))
                start, end = max(0, start - shift), max(0, start - shift) + WINDOW
                parts.append(own_text[start:end])
                row = np.zeros(WINDOW, dtype=np.int64)
                row[: len(tag[start:end])] = tag[start:end]
                tags.append(row)
                labelled += bool(row.any())
    if not labelled:
        return None
    chosen = rng.permutation(len(parts))[:windows]
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(_matrix([parts[k] for k in chosen]), np.stack([tags[k] for k in chosen]), EPOCHS)
    return tagger


def _spans_of(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Kind, start and end of the runs of tags of a window."""
    start = kind = None
    for k, tag in enumerate([*tags.tolist(), 0]):
        if start is not None and not (tag == 2 * kind + 2):
            yield kind, start, k
            start = None
        if tag % 2 == 1 or (tag and start is None):
            start, kind = k, (tag - 1) // 2


def _reconciled(spans: list[tuple[float, str, int, int]]) -> list[Span]:
    """Spans that don't overlap, with the highest sum of scores; ties to the earlier ones."""
    spans = sorted({(e, s, kind): score for score, kind, s, e in sorted(spans)}.items())
    best: list[tuple[float, int]] = [(0.0, -1)]
    ends = [e for (e, _, _), _ in spans]
    for k, ((_, start, _), score) in enumerate(spans):
        before = int(np.searchsorted(ends[:k], start, "right"))
        take = best[before][0] + score
        best.append((take, before) if take > best[-1][0] else (best[-1][0], -1))
    out, k = [], len(spans)
    while k:
        if best[k][1] >= 0:
            end, start, kind = spans[k - 1][0]
            out.append((kind, start, end))
            k = best[k][1]
        else:
            k -= 1
    return out[::-1]


#: Kind, start, end, sum of probabilities, and whether a border cuts it on the left or right.
Part = tuple[int, int, int, float, bool, bool]


def _whole(parts: list[Part]) -> list[tuple[float, str, int, int]]:
    """Spans with their scores: those that no border cuts, and those joined from parts of one kind."""
    out = [(total / (e - s), KINDS[kind], s, e) for kind, s, e, total, left, right in parts if not (left or right)]
    for kind in {p[0] for p in parts if p[4] or p[5]}:
        open_: list | None = None  # start, end, sum, length, whether its right end is cut, whether it has a cut part
        for _, s, e, total, left, right in [*sorted(p for p in parts if p[0] == kind), (kind, -1, -1, 0.0, False, False)]:
            if open_ and 0 <= s <= open_[1] and (open_[4] or left):
                cut = right if e > open_[1] else open_[4] and (right or e < open_[1])
                open_ = [open_[0], max(open_[1], e), open_[2] + total, open_[3] + e - s, cut, True]
                continue
            if open_ and open_[5]:
                out.append((open_[2] / open_[3], KINDS[kind], open_[0], open_[1]))
            open_ = [s, e, total, e - s, right, left or right]
    return out


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Plausible spans of each text by the tagger, from all its windows."""
    places = [(k, start, end) for k, text in enumerate(texts) for start, end in _windows(text)]
    seen = {(k, start) for k, start, _ in places}
    found: list[list[Part]] = [[] for _ in texts]
    while places:
        more = []
        for at in range(0, len(places), 256):
            part = places[at : at + 256]
            unary = tagger.unary(_matrix([texts[k][start:end] for k, start, end in part]))
            decoded = tagger.decode(unary)
            if not decoded.any():
                continue
            some = np.flatnonzero(decoded.any(axis=1))
            probability, _ = tagger.marginals(unary[:, some])
            for j, row in enumerate(some.tolist()):
                k, start, end = part[row]
                size = len(texts[k])
                for kind, a, b in _spans_of(decoded[row, : end - start]):
                    left, right = a == 0 and start > 0, b == end - start and end < size
                    total = float(probability[np.arange(a, b), j, decoded[row, a:b]].sum())
                    found[k].append((kind, start + a, start + b, total, left, right))
                    # a border that no other window reaches over gets one
                    for cut, other in ((left, max(0, start - STRIDE)), (right, start + STRIDE)):
                        if cut and (k, other) not in seen:
                            seen.add((k, other))
                            more.append((k, other, min(size, other + WINDOW)))
        places = more
    return [
        _reconciled([
            (score, kind, s, e) for score, kind, s, e in _whole(parts)
            if score >= MIN_SCORE and _ANCHOR.search(text[s:e]) and _plausible(kind, text[s:e])
        ])
        for text, parts in zip(texts, found, strict=True)
    ]


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(text) if _ANCHOR.search(text) else [] for text in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if tagger:
        some = [k for k, text in enumerate(texts) if _ANCHOR.search(text)]
        for k, spans in zip(some, model_spans([texts[k] for k in some], tagger), strict=True):
            taken = base[k]
            added[k] = [s for s in spans if all(s[2] <= b[1] or b[2] <= s[1] for b in taken)]
    return list(zip(base, added, strict=True))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> Tagger | None:
    """A tagger from at most ``sample_docs`` texts with a digit or ``@``, chosen by a hash.

    Texts above ``max_chars`` are left out of the sample, so that its size is bounded.
    """
    own = docs.select(F.col("text").cast("string").alias("text")).withColumn("order", F.xxhash64("text"))
    fitting = (F.length("text") <= max_chars) & F.col("text").rlike("[0-9]{3}|@")
    # first only hashes come to the driver, then the texts of the smallest, each once
    hashes = own.where(fitting).select("order").distinct().orderBy("order").limit(sample_docs).collect()
    if not hashes:
        return None
    chosen = own.where((F.col("order") <= hashes[-1]["order"]) & fitting).groupBy("order").agg(F.min("text").alias("text"))
    return fit([r["text"] for r in sorted(chosen.collect(), key=lambda r: r["order"])])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Adds ``base`` and ``added`` spans (``kind:start:end``, joined) to all columns of ``docs``.

    A null or empty text has none. Columns of these names that are there already are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("base string, added string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [pair for k in range(0, len(texts), 256) for pair in all_spans([t or "" for t in texts.iloc[k : k + 256].tolist()], shared.value)]
            yield pd.DataFrame({"base": [_joined(b) for b, _ in out], "added": [_joined(a) for _, a in out]}, dtype=str)

    found = docs.drop("base", "added", "_spans").withColumn("_spans", find(F.col("text").cast("string")))
    return found.select("*", "_spans.base", "_spans.added").drop("_spans")


def _ordered(base: Column, added: Column) -> Column:
    """Both lists as one, by start and then kind."""

    def parts(c: Column) -> Column:
        return F.transform(
            F.filter(F.split(c, ","), lambda x: x != ""),
            lambda x: F.struct(
                F.split(x, ":")[1].cast("long").alias("s"),
                F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"),
                x.alias("x"),
            ),
        )

    return F.array_join(F.transform(F.array_sort(F.concat(parts(base), parts(added))), lambda x: x["x"]), ",")


def report(docs: DataFrame, tagger: Tagger | None = None, learn: bool = True) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans``, ``n_added``, for every row.

    Repeated rows and null ids keep their own rows. An empty table gives an empty one.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = spans(own, train(own) if learn and tagger is None else tagger).drop("text")

    def count(kind: str) -> Column:
        mine = F.filter(F.split("base", ","), lambda x: F.startswith(x, F.lit(f"{kind}:")))
        return F.size(mine).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2("base", 256).alias("base_sha256"),
        _ordered(F.col("base"), F.col("added")).alias("spans"),
        F.size(F.filter(F.split("added", ","), lambda x: x != "")).cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as ``<EMAIL>``, and ``n_chars`` anew.

    Overlapping spans are replaced together, under the kind of the first. A null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.tolist()
            out: list[str | None] = []
            for k in range(0, len(own), 256):
                part = own[k : k + 256]
                for text, (base, added) in zip(part, all_spans([t or "" for t in part], shared.value), strict=True):
                    done, at = [], 0
                    for kind, start, end in sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]))):
                        if start >= at:
                            done += [text[at:start], f"<{kind.upper()}>"]
                        at = max(at, end)
                    out.append("".join(done) + text[at:] if at else text)
            yield pd.Series(out, dtype=object)

    changed = docs.withColumn("text", mask(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed
