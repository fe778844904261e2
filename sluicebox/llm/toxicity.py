"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, word pairs and triples, and of
word pairs with one or two words between them, in hashed buckets.  The learner
keeps for each bucket the sum of squared gradients, which sets that bucket's own
rate, and a lazily regularised sum of gradients: a bucket whose sum stays below
L1 has weight zero.  (Rates, L2 and the number of passes were chosen by folds of
the training rows; L1 is, in each fit, by the rows that the learner has not
seen.)  What is left is a short list of buckets and weights, which
goes to the tasks; its size is at most 12 bytes a bucket whatever the corpus.  As
L1 also shrinks the weights that stay, these buckets are learnt once more.  A
logistic curve, fitted on rows that the learner has not seen, turns margins into
scores.

The fit uses a bounded sample of the labelled training rows: TRAINING_ROWS, the
first by md5 of the id, read in that order.  Nothing else is sampled; whole
texts are read in training and scoring.

Defined results: null and empty texts have no features and get the score of the
bias alone; an id labelled more than once counts with its highest label, a null
label or id not at all; with labels of one class only (or none) every score is
that class (or 0.5); other columns are kept, but for the text and those that
have an output's name; an empty table gives an empty table.
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
from .quality import curve, sample

TRAINING_ROWS = 8000
BUCKET_BITS = 20
#: Rates: alpha / (beta + root of a bucket's summed squared gradients).
ALPHA, BETA = 2.0, 1.0
#: Values of L1 that are tried.
L1 = (5.0, 10.0, 20.0, 40.0)
L2 = 0.01
EPOCHS = 4
#: Rate and L1 of the second fit, which learns the chosen buckets alone and shrinks them less.
SECOND_ALPHA, SECOND_L1, SECOND_L2 = 0.5, 0.5, 0.1
#: Buckets that fewer rows of the sample have are not learnt.
MIN_ROWS = 2
#: One row in so many of the sample fits the curve instead of the weights.
CURVE_EVERY = 4
#: Distances of the second (and third) word of a gram from its first.
GRAMS = ((), (1,), (2,), (3,), (1, 2))


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the distinct buckets of each row's grams, sorted."""
    data, offsets = V.flat(column)
    starts, ends, first = V.word_spans(data, offsets, V.alnum_word_table())
    words = V.span_hashes(V.lower_table()[data], starts, ends)
    row = V.row_of(first)
    codes = []
    for kind, distances in enumerate(GRAMS):
        reach = max(distances, default=0)
        n = max(0, len(words) - reach)
        inside = row[:n] == row[reach : reach + n]
        code = words[:n] ^ np.uint64(kind)
        for d in distances:
            code = V.mix(code) + words[d : d + n]
        bucket = V.mix(code)[inside] >> np.uint64(64 - BUCKET_BITS)
        codes.append(row[:n][inside].astype(np.uint64) << np.uint64(BUCKET_BITS) | bucket)
    code = np.unique(np.concatenate(codes))
    return (code & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32), np.searchsorted(code >> np.uint64(BUCKET_BITS), np.arange(len(offsets)))


class Learner:
    """The state of FTRL-proximal: a sum of gradients and one of their squares for each bucket, the last being the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1[0], l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, buckets: np.ndarray, y: int) -> None:
        """One row with label 1 or 0."""
        at = np.append(buckets, len(self.z) - 1)
        w, n = self.weights(at), self.n[at]
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


@dataclass
class Model:
    """Weights of the buckets that have one."""

    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.buckets):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        known = self.buckets[at] == buckets
        row = np.repeat(np.arange(n), np.diff(offsets))[known]
        return np.bincount(row, weights=self.weights[at[known]], minlength=n) + self.bias

    def score(self, column) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(column)) + self.shift, -30, 30)))


def _passes(rows: list[np.ndarray], y: np.ndarray, allowed: np.ndarray, learner: Learner) -> np.ndarray:
    """Weights (the bias last) after EPOCHS passes over the rows' allowed buckets."""
    learnt = [r[allowed[r]] for r in rows]
    for _ in range(EPOCHS):
        for buckets, label in zip(learnt, y, strict=True):
            learner.learn(buckets, label)
    return learner.weights()


def _loss(margins: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -margins, margins)).mean())


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of rows (their buckets) with labels 1 and 0; of the values of L1 the one with the least loss on the late rows."""
    none = np.zeros(0, np.int32), np.zeros(0)
    if not len(y) or (y > 0).all() or not (y > 0).any():
        return Model(*none, 0.0, 1.0, 0.0 if not len(y) else 60.0 * y[0] - 30)
    late = np.arange(len(y)) % CURVE_EVERY == CURVE_EVERY - 1
    late &= bool(len(set(y[late])) == 2 and len(set(y[~late])) == 2)
    early, on = np.flatnonzero(~late), np.flatnonzero(late if late.any() else ~late)
    learnt, held = [rows[i] for i in early], [rows[i] for i in on]
    buckets, offsets = np.concatenate(held), np.append(0, np.cumsum([len(r) for r in held]))
    common = np.bincount(np.concatenate(learnt), minlength=1 << BUCKET_BITS) >= MIN_ROWS
    best, least = None, np.inf
    for l1 in L1:
        w = _passes(learnt, y[early], common, Learner(1 << BUCKET_BITS, l1=l1))
        w = _passes(learnt, y[early], w[:-1] != 0, Learner(1 << BUCKET_BITS, SECOND_ALPHA, l1=SECOND_L1, l2=SECOND_L2))
        at = np.flatnonzero(w[:-1]).astype(np.int32)
        model = Model(at, w[at], float(w[-1]), 1.0, 0.0)
        margins = model.margins(buckets, offsets)
        model.slope, model.shift = curve(margins, np.where(y[on] > 0, 1, -1))
        loss = _loss(model.slope * margins + model.shift, y[on])
        if loss < least:
            best, least = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, chosen: Column, label: str = "toxic", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``chosen`` (over doc_id) holds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                buckets, offsets = features(part.column("sb_text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(buckets))
                yield pa.RecordBatch.from_arrays([part.column("sb_key"), part.column("sb_y"), lists], names=["k", "y", "f"])

    # The sample is of at most ``rows`` ids, so it can be broadcast.
    picked = F.broadcast(sample(labels, chosen, label, rows))
    texts = docs.select("doc_id", F.col(text).alias("sb_text")).join(picked, "doc_id")
    keyed = texts.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sb_key"), "sb_y", "sb_text")
    # Repeated rows of an id could pass the bound: one row for each id.
    once = keyed.transform(map_batches, extract, "k string, y int, f array<int>").groupBy("k").agg(F.max("y").alias("y"), F.max("f").alias("f"))
    found = once.toArrow().sort_by("k")
    lists = found.column("f").combine_chunks()
    flat, cut = lists.flatten().to_numpy(), np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    y = (found.column("y").to_numpy() > 0).astype(int)
    return fit([flat[cut[i] : cut[i + 1]] for i in range(len(y))], y)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without text, with score and predicted."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text):
                s = shared.value.score(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.transform(map_batches, run, schema)
