"""Toxicity: a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel of two units (words, and runs of single letters) counts the subsequences of three
letters that they share, each weighted by ``DECAY`` for every gap, over at most ``SPAN``
places; what isn't a letter is a gap. So inserted characters lower a likeness and don't end it.
Landmarks are units of the labelled sentences; a unit's features are its kernels with them,
made independent (Nyström). A linear machine on these is trained on labelled sentences, each
stood for by its highest unit: all sentences of clean documents count as clean, of toxic documents the
highest ones as toxic, over a few rounds. As the kernel is a sum over subsequences, the trained
machine is a table with one weight for each, and a unit is scored by looking them up.

A document's score comes from a logistic regression on its highest units and on how many
lie above the margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm._sample import held_out, labelled
from keyfold.llm._words import Words, each

DECAY = 0.7
SPAN = 6
LANDMARKS = 64
#: Bounds of the training sample.
DOCS_PER_CLASS = 800
MAX_CHARS = 10_000
ROUNDS = 4
RIDGE = 1e-3
#: Telling units that landmarks are picked from.
CANDIDATES = 120
#: Log odds above which a unit can stand for a toxic sentence.
MIN_SHARE = 0.7
TOP = 3
MARGINS = (0.0, 0.5, 0.8, 0.9)
FEATURES = TOP + len(MARGINS) + 3

_CODE = np.zeros(256, dtype=np.int64)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
# the last byte of an accented letter; its bits without the case bit of Latin letters
_CODE[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 0x1F)
_START = 63
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges and documents of all units of a range of documents."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    single = np.concatenate([[False], words.ends - words.starts == 1, [False]])
    begin = np.flatnonzero(single[1:] & ~single[:-1])
    end = np.flatnonzero(~single[1:] & single[:-1])
    # a run that goes on into another document is split by it
    runs = [
        (words.starts[lo], words.ends[hi - 1], d)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True)
        if e - b >= 3
        for d in range(doc[b], doc[e - 1] + 1)
        for lo, hi in [(max(b, words.first[d]), min(e, words.first[d + 1]))]
        if hi - lo >= 3
    ]
    if not runs:
        return words.starts, words.ends, doc
    more = np.array(runs, dtype=np.int64).T
    return tuple(np.concatenate([x, y]) for x, y in zip((words.starts, words.ends, doc), more, strict=True))


def subsequences(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, subsequence and weight of every gapped subsequence of the units ``raw[start:end]``."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(int(sizes.sum())) - first[unit]
    codes = _CODE[raw[np.maximum(starts[unit] + inner - 1, 0)]]
    codes[inner == 0] = _START
    left = sizes[unit] - inner
    out = []
    for a, b in _GAPS:
        at = np.flatnonzero((codes[: len(codes) - a - b] > 0) & (left[: len(codes) - a - b] > a + b))
        at = at[(codes[at + a] > 0) & (codes[at + a + b] > 0)]
        out.append((unit[at], (codes[at] << 12) | (codes[at + a] << 6) | codes[at + a + b], np.full(len(at), DECAY ** (a + b - 2))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _norms(unit: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(unit, weight * weight, n), 1.0))


@dataclass
class Model:
    """A weight for every subsequence, and the regression of a document's score."""

    weights: np.ndarray
    bias: float
    document: np.ndarray

    def unit_scores(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        unit, item, weight = subsequences(raw, starts, ends)
        total = np.bincount(unit, weight * self.weights[item], len(starts))
        return total / _norms(unit, weight, len(starts)) + self.bias

    def features(self, words: Words) -> np.ndarray:
        """A row for every document: bias, highest units, how many lie above the margin, their share, size."""
        n = len(words.first) - 1
        starts, ends, doc = _units(words)
        out = np.zeros((n, FEATURES))
        out[:, 0] = 1
        out[:, 1 : TOP + 1] = -2
        if not len(starts):
            return out
        # equal words have equal scores
        own = len(words.starts)
        _, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        scores = np.concatenate([
            self.unit_scores(words.raw, words.starts[at], words.ends[at])[inverse],
            self.unit_scores(words.raw, starts[own:], ends[own:]),
        ])
        order = np.lexsort((-scores, doc))
        begin = np.searchsorted(doc[order], np.arange(n))
        count = np.bincount(doc, minlength=n)
        for k in range(TOP):
            has = count > k
            out[has, 1 + k] = np.clip(scores[order[begin[has] + k]], -2, 3)
        for k, margin in enumerate(MARGINS):
            out[:, TOP + 1 + k] = np.log1p(np.bincount(doc, scores > margin, n))
        out[:, -2] = 20 * np.bincount(doc, scores > 0, n) / np.maximum(count, 1)
        out[:, -1] = np.log1p(count) / 4
        return out

    def score(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(words) @ self.document, -30, 30)))


@dataclass
class _Table:
    """Weights of the subsequences of some units, over the unit's norm; row 0 is for all others."""

    row_of: np.ndarray
    rows: np.ndarray

    def spread(self, by: np.ndarray) -> np.ndarray:
        """A weight for every subsequence there can be."""
        return (self.rows @ by)[self.row_of].astype(np.float32)


def _table(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> _Table:
    unit, item, weight = subsequences(raw, starts, ends)
    items, row = np.unique(item, return_inverse=True)
    row_of = np.zeros(64**3, dtype=np.int32)
    row_of[items] = np.arange(1, len(items) + 1)
    rows = np.zeros((len(items) + 1, len(starts)), dtype=np.float32)
    np.add.at(rows, (row + 1, unit), weight)
    return _Table(row_of, rows / _norms(unit, weight, len(starts)).astype(np.float32))


def _kernels(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: _Table) -> np.ndarray:
    """Kernels of units with those of the table."""
    found = np.zeros((len(starts), table.rows.shape[1]), dtype=np.float32)
    for k in range(0, len(starts), 1_000):
        n = len(starts[k : k + 1_000])
        unit, item, weight = subsequences(raw, starts[k : k + n], ends[k : k + n])
        norm, row = _norms(unit, weight, n), table.row_of[item]
        order = np.argsort(unit[row > 0], kind="stable")
        unit, row, weight = unit[row > 0][order], row[row > 0][order], weight[row > 0][order]
        if len(unit):
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            sums = np.add.reduceat(table.rows[row] * weight[:, None].astype(np.float32), heads)
            found[k + unit[heads]] = sums / norm[unit[heads], None]
    return found


def _squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps for a linear machine with squared hinge loss; the last column of z is 1."""
    w = np.zeros(z.shape[1])
    for _ in range(25):
        active = y * (z @ w) < 1
        za, wa = z[active], weight[active]
        h = (za * wa[:, None]).T @ za + ridge * np.eye(z.shape[1])
        new = np.linalg.solve(h, (za * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """A regression in which no toxic unit lowers a score: such weights are set to 0, the worst first."""
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        w, own = np.zeros(x.shape[1]), x[:, use]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (own * (p * (1 - p) + 1e-6)[:, None]).T @ own + ridge * np.eye(own.shape[1])
            w[use] += np.linalg.solve(h, own.T @ (y - p) - ridge * w[use])
        worst = 1 + int(np.argmin(w[1:-1]))
        if w[worst] >= 0:
            return w
        use[worst] = False


def fit(sample: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """A model from texts with labels. Without both classes, every score is the share of toxic ones."""
    labels = np.array([y for _, y in sample], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        flat = np.zeros(FEATURES)
        flat[0] = np.log(share / (1 - share))
        return Model(np.zeros(64**3, dtype=np.float32), 0.0, flat)
    column = pa.array([text for text, _ in sample], pa.string())
    chunks = [(first, words) for first, _, words in each(column, "space")]
    # distinct units of the sample, and the sentences they occur in
    raws, starts, ends, keys, sentence, doc, base, at = [], [], [], [], [], [], 0, 0
    for first, words in chunks:
        a, b = words.starts, words.ends
        # a sentence ends with a mark at the end of a word, a line, or the document
        last = words.raw[b - 1]
        stop = (last == 46) | (last == 33) | (last == 63)
        lines = np.concatenate([[0], np.cumsum(words.raw == 10)])[a]
        new = np.ones(len(a), dtype=bool)
        own = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        new[1:] = stop[:-1] | (lines[1:] != lines[:-1]) | (own[1:] != own[:-1])
        number = np.cumsum(new) + base
        base = int(number[-1]) if len(number) else base
        raws.append(words.raw)
        starts.append(a + at)
        ends.append(b + at)
        keys.append(words.hashes)
        sentence.append(number)
        doc.append(own + first)
        at += len(words.raw)
    raw = np.concatenate(raws)
    starts, ends, keys, sentence, doc = (np.concatenate(x) for x in (starts, ends, keys, sentence, doc))
    _, one, unit_of = np.unique(keys, return_index=True, return_inverse=True)
    toxic_doc = labels[doc] == 1
    pairs = np.unique(np.stack([unit_of, doc]), axis=1)
    in_toxic = np.bincount(pairs[0], labels[pairs[1]] == 1, len(one))
    in_clean = np.bincount(pairs[0], labels[pairs[1]] == 0, len(one))
    share = np.log((in_toxic + 0.5) / (labels.sum() + 1)) - np.log((in_clean + 0.5) / ((labels == 0).sum() + 1))
    telling = in_toxic * share
    # landmarks: telling units of toxic documents that differ, and frequent ones of clean documents
    likely = np.argsort(-telling, kind="stable")[:CANDIDATES]
    item_table = _table(raw, starts[one[likely]], ends[one[likely]])
    alike = _kernels(raw, starts[one[likely]], ends[one[likely]], item_table)
    worth, nearest, picked = np.maximum(telling[likely], 0), np.zeros(len(likely)), []
    for _ in range(min(landmarks * 3 // 4, len(likely))):
        picked.append(int(np.argmax(worth * (1 - nearest))))
        nearest = np.maximum(nearest, np.minimum(alike[:, picked[-1]], 1))
    toxic_marks = likely[picked]
    clean_marks = np.argsort(-in_clean, kind="stable")
    clean_marks = clean_marks[~np.isin(clean_marks, toxic_marks)][: landmarks - len(toxic_marks)]
    marks = one[np.concatenate([toxic_marks, clean_marks])]
    # kernels of all units with the landmarks
    table = _table(raw, starts[marks], ends[marks])
    kernels = _kernels(raw, starts[one], ends[one], table)
    own = kernels[unit_of[marks]].astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-4 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = np.ones((len(one), int(keep.sum()) + 1), dtype=np.float32)
    np.matmul(kernels, whiten.astype(np.float32), out=z[:, :-1])
    del kernels
    # rounds: each sentence stands for its highest unit under the machine so far
    score = telling.astype(np.float64)
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        order = np.lexsort((-score[unit_of], sentence))
        head = order[np.append(True, sentence[order][1:] != sentence[order][:-1])]
        bad = head[toxic_doc[head]]
        bad = bad[np.lexsort((-score[unit_of[bad]], doc[bad]))]
        rank = np.arange(len(bad)) - np.searchsorted(doc[bad], doc[bad])
        positive = np.unique(unit_of[bad[rank < 2]])
        positive = positive[share[positive] > MIN_SHARE]
        clean = unit_of[head[~toxic_doc[head]]]
        extra = unit_of[rng.choice(len(unit_of), min(20_000, len(unit_of)), replace=False)]
        negative = np.setdiff1d(np.concatenate([clean, extra[in_toxic[extra] <= in_clean[extra]]]), positive)
        chosen = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        balance = np.concatenate([
            (1 + in_toxic[positive]) / (1 + in_toxic[positive]).sum(), (1 + in_clean[negative]) / (1 + in_clean[negative]).sum()
        ]) * len(chosen)
        w = _squared_hinge(z[chosen].astype(np.float64), y, balance, RIDGE * len(chosen))
        score = z @ w
    weights = table.spread((whiten @ w[:-1]).astype(np.float32))
    model = Model(weights, float(w[-1]), np.zeros(FEATURES))
    features = np.concatenate([model.features(words) for _, words in chunks])
    model.document = _logistic(features, labels)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from at most ``2 * per_class`` labelled documents outside of the held-out fold.

    The regression's bias is moved from the classes' share in the sample to that in all labels.
    """
    sample = labelled(docs, labels, "toxic", per_class, max_chars)
    model = fit(sample)
    own = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    drawn = sum(y for _, y in sample) / max(len(sample), 1)
    if own is not None and 0 < own < 1 and 0 < drawn < 1:
        model.document[0] += np.log(own / (1 - own)) - np.log(drawn / (1 - drawn))
    return model


def score_of(model: Model, spark: SparkSession) -> Callable[[str], Column]:
    """A function of a text column that gives the score of whole texts; a null text is empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            column = pa.array(texts, pa.string(), from_pandas=True)
            parts = [shared.value.score(words) for _, _, words in each(column, "space")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return lambda name: score(F.col(name).cast("string"))


def below(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns."""
    return docs.where(score_of(model, docs.sparkSession)("text") < threshold)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Without labels of both classes every document has the same score. Repeated rows are scored
    each; a null ``doc_id`` is not held out. An empty table gives an empty one.
    """
    score = score_of(train(docs, labels), docs.sparkSession)("text").alias("score")
    return docs.select("doc_id", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
