"""Quality classifier: a linear-chain CRF over lines, with features of the lines around.

Every line that holds a word gets features of its own (symbols, capitals, digits, repeated and
common words, word lengths, whether it stood before) and those of the lines before and behind. A
chain of two labels, good and bad, runs over a document's lines. It is trained on labelled
documents, whose label holds for all their lines. A document's quality is the mean of its
lines' probabilities of good by forward-backward, weighted by length, brought to the scale of
the labels by a regression on it, on its spread, and on the document's size.
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
from keyfold.llm._words import U64, Words, each, mix

DOCS_PER_CLASS = 1_000
MAX_CHARS = 20_000
COMMON_WORDS = 400
STEPS = 200
THRESHOLD = 0.3

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>!=^~{}[]\\_@+")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:?")] = True
OWN_FEATURES = 12


def _share(flags: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags.astype(np.float64), heads) / sizes


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of every line that holds a word."""
    breaks = np.concatenate([[0], np.cumsum(words.raw == 10)])[words.starts]
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return heads, np.diff(np.append(heads, len(doc))), doc[heads]


def features(words: Words, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, document and word count of every line."""
    heads, sizes, doc = lines_of(words)
    if not len(heads):
        return np.zeros((0, 3 * OWN_FEATURES + 1)), doc, sizes
    begin, end = words.starts[heads], words.ends[heads + sizes - 1]
    sums = [np.concatenate([[0], np.cumsum(table[words.raw])]) for table in (_UPPER, _DIGIT, _SYMBOL, _STOP)]
    letters = np.add.reduceat(words.ends - words.starts, heads)
    upper, digit, symbol, stop = ((s[end] - s[begin]) / letters for s in sums)
    line = np.repeat(np.arange(len(heads)), sizes)
    # distinct words of a line: sorted by line and hash
    order = np.lexsort((words.hashes, line))
    fresh = np.ones(len(line), dtype=bool)
    fresh[1:] = (line[order][1:] != line[order][:-1]) | (words.hashes[order][1:] != words.hashes[order][:-1])
    again = np.zeros(len(line), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (line[1:] == line[:-1])
    known = common[np.minimum(np.searchsorted(common, words.hashes), len(common) - 1)] == words.hashes
    size = words.ends - words.starts
    odd_end = _SYMBOL[words.raw[words.ends - 1]]
    # a line that stood before in its document
    place = np.arange(len(line)) - heads[line]
    keys = np.add.reduceat(mix(words.hashes + place.astype(U64)), heads)
    by = np.lexsort((np.arange(len(heads)), keys, doc))
    stood = np.zeros(len(heads), dtype=bool)
    stood[by[1:]] = (keys[by][1:] == keys[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    own = np.stack(
        [
            upper, 4 * digit, symbol, stop, _share(fresh[np.argsort(order)], heads, sizes), _share(again, heads, sizes),
            _share(known, heads, sizes), np.minimum(letters / sizes, 20) / 10, _share(size <= 3, heads, sizes),
            _share(odd_end, heads, sizes), stood, np.log1p(sizes) / 5,
        ],
        axis=1,
    )
    same = doc[1:] == doc[:-1]
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    behind[:-1][same] = own[1:][same]
    return np.concatenate([np.ones((len(own), 1)), own, before, behind], axis=1), doc, sizes


def forward_backward(unary: np.ndarray, first: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for every line, and the expected transitions, of all chains at once.

    ``unary`` is the score of good over bad. Chains that are longer go on alone.
    """
    by = np.argsort(-counts, kind="stable")
    first, counts = first[by], counts[by]
    scores = np.stack([np.zeros(len(unary)), unary], axis=1)
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    total = np.zeros(len(unary))
    longest = int(counts[0]) if len(counts) else 0
    running = [int(np.searchsorted(-counts, -t, "left")) for t in range(longest + 1)]  # chains with more than t lines
    for t in range(longest):
        at = first[: running[t]] + t
        if t == 0:
            ahead[at] = scores[at]
        else:
            p = ahead[at - 1]
            ahead[at] = scores[at] + np.logaddexp(p[:, :1] + step[0], p[:, 1:] + step[1])
    ends = first + counts - 1
    sums = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    for t in range(longest - 2, -1, -1):
        at = first[: running[t + 1]] + t
        q = scores[at + 1] + back[at + 1]
        back[at] = np.logaddexp(q[:, :1] + step[:, 0], q[:, 1:] + step[:, 1])
    chain = np.repeat(np.arange(len(first)), counts)
    where = np.concatenate([np.arange(f, f + c) for f, c in zip(first.tolist(), counts.tolist(), strict=True)]) if len(first) else chain
    total[where] = sums[chain]
    good = np.exp(ahead[:, 1] + back[:, 1] - total)
    inner = np.setdiff1d(where, ends)
    pair = ahead[inner][:, :, None] + step + (scores[inner + 1] + back[inner + 1])[:, None, :] - total[inner][:, None, None]
    return good, np.exp(pair).sum(axis=0)


@dataclass
class Model:
    """Weights of a line's features, of label pairs, and of the regression."""

    common: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    document: np.ndarray

    def summary(self, words: Words) -> np.ndarray:
        n = len(words.first) - 1
        out = np.zeros((n, 5))
        out[:, 0] = 1
        x, doc, sizes = features(words, self.common)
        if len(x):
            docs, first, counts = np.unique(doc, return_index=True, return_counts=True)
            good, _ = forward_backward(x @ self.weights, first, counts, self.step)
            all_words = np.bincount(doc, sizes, n)
            mean = np.bincount(doc, sizes * good, n)[docs] / all_words[docs]
            out[docs, 1] = mean
            out[docs, 2] = np.bincount(doc, sizes * np.clip(x @ self.weights, -8, 8), n)[docs] / all_words[docs] / 4
            out[docs, 3] = np.log1p(all_words[docs]) / 4
            out[docs, 4] = np.log1p(counts) / 4
        return out

    def score(self, words: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(words) @ self.document, -30, 30)))


def fit(sample: list[tuple[str, int]]) -> Model:
    """A model from texts with labels. Without both classes, every score is the share of good ones."""
    labels = np.array([y for _, y in sample], dtype=np.float64)
    chunks = [(first, words) for first, _, words in each(pa.array([t for t, _ in sample], pa.string()), "space")]
    width = 3 * OWN_FEATURES + 1
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        flat = np.array([np.log(share / (1 - share)), 0, 0, 0, 0])
        return Model(np.zeros(1, dtype=U64), np.zeros(width), np.zeros((2, 2)), flat)
    # the words that most good documents hold
    held = [np.unique(np.stack([w.hashes, np.repeat(np.arange(len(w.first) - 1) + f, np.diff(w.first)).astype(U64)]), axis=1) for f, w in chunks]
    held = np.concatenate(held, axis=1)
    values, n = np.unique(held[0][labels[held[1].astype(np.int64)] == 1], return_counts=True)
    common = np.sort(values[np.argsort(-n, kind="stable")[:COMMON_WORDS]]) if len(values) else np.zeros(1, dtype=U64)
    parts = [features(w, common) for _, w in chunks]
    x = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + f for (f, _), p in zip(chunks, parts, strict=True)])
    docs, first, counts = np.unique(doc, return_index=True, return_counts=True)
    y = labels[doc]
    # a document weighs alike whatever its length, so that long ones don't decide alone
    theta, step = np.zeros(width), np.zeros((2, 2))
    inner = np.ones(len(doc), dtype=bool)
    inner[first + counts - 1] = False
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[inner].astype(int), y[np.flatnonzero(inner) + 1].astype(int)), 1)
    m1, m2 = np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, STEPS + 1):
        good, pairs = forward_backward(x @ theta, first, counts, step)
        grad = np.concatenate([x.T @ (good - y) + 0.5 * theta, (pairs - gold).ravel() + 0.5 * step.ravel()]) / len(doc)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        theta, step = theta - move[:width], step - move[width:].reshape(2, 2)
    # labels of a chain never change, so that its pairs could grow without end
    model = Model(common, theta, np.clip(step, -2, 2), np.zeros(5))
    z = np.concatenate([model.summary(w) for _, w in chunks])
    w = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.05 * np.eye(5)
        w = w + np.linalg.solve(h, z.T @ (labels - p) - 0.05 * w)
    model.document = w
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from at most ``2 * per_class`` labelled documents outside of the held-out fold.

    Classes are drawn alike often; the regression's bias is moved to their share in all labels.
    """
    sample = labelled(docs, labels, "quality", per_class, max_chars)
    model = fit(sample)
    own = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("quality").cast("double")).alias("share")).first()["share"]
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


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Without labels of both classes every document has the same score. Repeated rows are scored
    each; a null ``doc_id`` is not held out. An empty table gives an empty one.
    """
    score = score_of(train(docs, labels), docs.sparkSession)("text").alias("score")
    return docs.select("doc_id", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
