"""Quality classifier: a linear support vector machine over naive Bayes features.

A text's features are indicators of its n-grams (words, word pairs, and four
characters of its shape) in hashed buckets.  Each is scaled by the log-count
ratio of its bucket between the classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve,
fitted on rows that the descent has not seen, turns margins into scores.

The fit uses a bounded sample of the labelled training rows: TRAINING_ROWS, the
first by md5 of the id.  The sample is joined by broadcast, which that bound
makes safe; nothing else is sampled.

Defined results: null and empty texts have no features and get the score of the
bias alone; an id labelled more than once counts with its highest label, a null
label not at all; with labels of one class only (or none) every score is that
class (or 0.5); other columns are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches

TRAINING_ROWS = 8000
BUCKET_BITS = 18
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: One row in so many of the sample fits the curve instead of the margin.
CURVE_EVERY = 4


def _shapes() -> np.ndarray:
    """Letters by case, digits and white space each as one byte; other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[97:123] = t[128:] = ord("a")
    t[65:91] = ord("A")
    t[48:58] = ord("0")
    t[9:14] = 32
    return t


SHAPES = _shapes()


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the distinct buckets of each row's n-grams, sorted."""
    data, offsets = V.flat(column)
    n = len(offsets) - 1
    starts, ends, first = V.word_spans(data, offsets, V.space_word_table())
    words = V.span_hashes(V.lower_table()[data], starts, ends)
    row = V.row_of(first)
    pairs = V.gram_hashes(words, 2)
    inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    again = words[1:] == words[:-1]
    pairs = np.where(again, np.uint64(0x5EED), pairs)  # any word that follows itself is one feature
    shape = SHAPES[data].astype(np.uint64)
    four = shape[:-3] << np.uint64(24) | shape[1:-2] << np.uint64(16) | shape[2:-1] << np.uint64(8) | shape[3:] if len(data) >= 4 else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    whole = doc[:-3] == doc[3:] if len(data) >= 4 else np.zeros(0, bool)
    at = np.concatenate([row, row[:-1][inside] if len(row) else row, doc[:-3][whole] if len(data) >= 4 else doc[:0]])
    kind = np.concatenate([V.mix(words), V.mix(pairs[inside] ^ np.uint64(1)), V.mix(four[whole] ^ np.uint64(2 << 40))])
    code = np.unique(at.astype(np.uint64) << np.uint64(BUCKET_BITS) | kind >> np.uint64(64 - BUCKET_BITS))
    return (code & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32), np.searchsorted(code >> np.uint64(BUCKET_BITS), np.arange(n + 1))


@dataclass
class Model:
    weights: np.ndarray  # of indicators, before rows are brought to unit length
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, column) -> np.ndarray:
        buckets, offsets = features(column)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        n = len(offsets) - 1
        length = np.sqrt(np.bincount(row, weights=self.ratios[buckets] ** 2, minlength=n))
        margin = np.bincount(row, weights=self.weights[buckets], minlength=n) / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def sample(labels: DataFrame, chosen: Column, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id and y of at most ``rows`` labelled rows."""
    known = labels.where(chosen & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("sb_y"))
    return known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)


def descend(x: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; (weights, bias)."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    # Both classes weigh alike.
    cost = COST * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(1)
    norm = np.array([v @ v + 1 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[x[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins (Newton, lightly regularised)."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of rows (their buckets) with labels +1 and -1."""
    size = 1 << BUCKET_BITS
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0 if not len(y) else 30.0 * y[0])
    late = np.arange(len(y)) % CURVE_EVERY == CURVE_EVERY - 1
    late &= bool(late.any() and len(set(y[late])) == 2 and len(set(y[~late])) == 2)
    early = np.flatnonzero(~late)
    counts = {s: SMOOTHING + np.bincount(np.concatenate([rows[i] for i in early if y[i] == s]), minlength=size) for s in (1, -1)}
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    values = [ratios[r] / max(np.sqrt((ratios[r] ** 2).sum()), 1e-9) for r in rows]
    w, b = descend([rows[i] for i in early], [values[i] for i in early], y[early], size)
    on = np.flatnonzero(late) if late.any() else early
    slope, shift = curve(np.array([w[rows[i]] @ values[i] + b for i in on]), y[on])
    return Model(w * ratios, ratios, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, chosen: Column, label: str = "quality", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``chosen`` (over doc_id) holds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                buckets, offsets = features(part.column("sb_text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(buckets))
                yield pa.RecordBatch.from_arrays([part.column("sb_key"), part.column("sb_y"), lists], names=["k", "y", "f"])

    picked = F.broadcast(sample(labels, chosen, label, rows))
    joined = docs.select("doc_id", F.col(text).alias("sb_text")).join(picked, "doc_id").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sb_key"), "sb_y", "sb_text")
    # Repeated rows of an id could pass the bound: one row for each id.
    found = joined.transform(map_batches, extract, "k string, y int, f array<int>").groupBy("k").agg(F.max("y").alias("y"), F.max("f").alias("f")).toArrow().sort_by("k")
    y = np.where(found.column("y").to_numpy() > 0, 1, -1)
    lists = found.column("f").combine_chunks()
    flat, cut = lists.flatten().to_numpy(), np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    return fit([flat[cut[i] : cut[i + 1]] for i in range(len(y))], y)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without text, with score and predicted."""
    names = ("score", "predicted")
    kept = [f for f in docs.schema.fields if f.name not in (text, *names)]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text):
                s = shared.value.score(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.transform(map_batches, run, schema)
