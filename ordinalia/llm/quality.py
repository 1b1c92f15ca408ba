"""Quality classifier: naive Bayes support vectors.

Features are the words and word pairs that a text contains (indicators, hashed to 2 ** BITS places), words in lower
case, digits folded, with the punctuation around them as tokens of their own, and the text's shape words.
Indicators are scaled by the log-count ratio of the two classes, then a linear hinge-loss model is fitted by dual
coordinate descent, and blended with the mean weight as naive Bayes support vectors prescribe.  A sigmoid fitted to the
margins of rows left out of the fit turns margins into scores.

The fit uses a bounded sample (PER_CLASS rows of each class, at most FEATURES indicators in all); every document
is scored whole, in batches, with one broadcast weight vector of fixed size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import text_of, without
from ordinalia.llm.labelled import sample

BITS = 18
#: Bounds of the sample: rows of each class, indicators in all.
PER_CLASS, FEATURES = 3000, 20_000_000
#: Added to every count; cost of a margin violation; passes; share of the scaled weights against their mean.
ALPHA, COST, PASSES, BLEND = 1.0, 0.1, 12, 0.75
SEED = 1
WORDS_KEPT = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Memory(dict):
    """Hash of each word met in this task; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        # a word counts by its letters; its digits, capitals and attached marks count as classes
        plain = re.sub(r"[0-9]+", "0", word.lower())
        value = self[word] = zlib.crc32(plain.encode()) + (1 << 32) * len(re.sub(r"[\w]", "", word)[:3])
        return value


def indicators(text: str, memory: _Memory) -> np.ndarray:
    """Sorted places of the words and word pairs that ``text`` contains; a text without words has none."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    one = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words)) * _MIX
    marks = _shape(text, words)
    two = (one[:-1] * np.uint64(31) + one[1:]) * _MIX
    return np.unique(np.concatenate([one, two, marks]) >> np.uint64(64 - BITS)).astype(np.int64)


def _shape(text: str, words: list[str]) -> np.ndarray:
    """Indicators of the endings of words (last two characters): lists, marks and capitals leave one kind only."""
    ends = {w[-1] for w in words} | {w[:2] for w in words if not w[0].isalnum()}
    upper = sum(map(str.isupper, words)) * 5 // len(words)
    distinct = len(set(words)) * 10 // len(words) if len(words) >= 20 else 10
    length = min(12, len(words).bit_length())
    marks = min(10, sum(not w[-1].isalnum() for w in words) * 10 // len(words))
    made = [f"\0end{e}" for e in ends] + [f"\0up{upper}", f"\0distinct{distinct}", f"\0length{length}", f"\0marks{marks}"]
    return np.array([zlib.crc32(m.encode()) for m in made], dtype=np.uint64) * _MIX


def featured(rows: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``also`` and ``places`` (little-endian 32-bit integers) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory()
        for batch in batches:
            made = [indicators(x.as_py(), memory).astype("<i4").tobytes() for x in batch.column(len(also))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(also)], pa.array(made, pa.binary())], names=[*also, "places"])

    kept = rows.select(*also, text_of(text).alias(text))
    return kept.mapInArrow(run, kept.drop(text).withColumn("places", F.lit(b"")).schema)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of  1/2 |w|^2 + cost * sum of hinge losses  by dual coordinate descent.

    Features of a row are ``scale`` at its places, divided by the length of that vector, and a bias feature of 1.
    """
    size = len(scale)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    values = []
    for places in rows:
        v = scale[places]
        norm = math.sqrt(float(v @ v))
        values.append(v / norm if norm else v)
    squares = np.array([float(v @ v) + 1.0 for v in values])
    costs = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(SEED)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            places, v = rows[i], values[i]
            gradient = y[i] * (float(w[places] @ v) + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), costs[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[places] += step * v
                w[size] += step
                alpha[i] = new
    return w[:size], float(w[size])


class Model:
    """weights (already scaled), bias, and the sigmoid's slope and offset; plain arrays of fixed size."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0) -> None:
        self.scale, self.weights, self.bias, self.slope, self.offset = scale, weights, bias, slope, offset

    def margin(self, places: np.ndarray) -> float:
        v = self.scale[places]
        norm = math.sqrt(float(v @ v))
        return (float(self.weights[places] @ v) / norm if norm else 0.0) + self.bias

    def score(self, places: np.ndarray) -> float:
        z = self.slope * self.margin(places) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    size = 1 << BITS
    counts = {}
    for sign in (1, -1):
        c = np.full(size, ALPHA)
        for places in (r for r, s in zip(rows, y) if s == sign):
            c[places] += 1
        counts[sign] = c / c.sum()
    ratio = np.log(counts[1] / counts[-1])
    w, bias = descend(rows, y, ratio)
    # the indicators are scaled by the ratios already, so the mean magnitude alone is naive Bayes
    met = np.zeros(size, dtype=bool)
    for places in rows:
        met[places] = True
    mean = np.abs(w[met]).mean() if met.any() else 0.0
    return Model(ratio, BLEND * w + (1 - BLEND) * mean * met, bias)


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Fits on four fifths, fits the sigmoid on the margins of the rest, then refits on all.

    With one class only (or no row) the model scores that class's prior, 0.5 without rows.
    """
    y = np.where(np.array(labels, dtype=int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, math.log(share / (1 - share)))
    out = np.arange(len(rows)) % 5 == 0
    first = _train([r for r, o in zip(rows, out) if not o], y[~out]) if len(set(y[~out].tolist())) == 2 else None
    model = _train(rows, y)
    held = [(first or model).margin(r) for r, o in zip(rows, out) if o]
    model.slope, model.offset = _sigmoid(np.array(held), y[out])
    return model


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic regression of the class on the margin, by Newton steps; slope above 0."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (beta - [1.0, 0.0])
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, gradient)
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else (1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows; rows arrive partition by partition and stop at FEATURES indicators."""
    chosen = featured(sample(docs, labels, label, allowed, per_class), also=("doc_id", "label"))
    kept = chosen.orderBy(F.xxhash64("doc_id"), "doc_id")
    rows, marks, total = [], [], 0
    for r in kept.toLocalIterator():
        rows.append(np.frombuffer(r["places"], dtype="<i4").astype(np.int64))
        marks.append(r["label"])
        total += len(rows[-1])
        if total > FEATURES:
            break
    return fit(rows, marks)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1, higher: class 1 likelier) and ``predicted``; the text is dropped unless listed again.

    A null or empty text scores as a text without words.  Rows and other columns stay, columns of these names are
    replaced.
    """
    kept = without(docs, text, "score", "predicted")
    at = kept.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model.__dict__)  # 2 ** BITS doubles twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, own = _Memory(), Model(**sent.value)
        for batch in batches:
            scores = [own.score(indicators(x.as_py() or "", memory)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)
