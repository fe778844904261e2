"""Language ID of mixed-language text.

Words are scored for each language by the log-probabilities of their byte
n-grams (one to three bytes, with the word's ends), learnt from labelled texts.
The script range of a word's first letter narrows its candidate languages to
those that use the script.  Viterbi over the words of a text, with a penalty for
each switch of language, then labels spans; a text's language is the one that
holds most of its letters, and its score is that share.

The counts behind the model are taken over all training rows, in tasks that hold
COUNTED_TOGETHER languages at once, and merged by Spark.  There is no limit on
the number of languages; the model has a float for each bucket and language,
which is 1.3 MB a language in the driver and in each worker.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the language first by name; without any training row every text is
``und``; other columns are kept and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches

#: Buckets of the trigrams; single bytes and pairs have one each.
TRIGRAM_BITS = 18
BASES = (0, 256, 256 + (1 << 16))
DIMENSIONS = BASES[2] + (1 << TRIGRAM_BITS)
SMOOTHING = 0.5
#: Log-probability that a switch of language costs.
SWITCH_PENALTY = 8.0
#: A language uses a script if it has this share of its words.
SCRIPT_SHARE = 0.001
#: Log-probability by which words may fall short of their language's training words, for each letter.
#: Midway between what folds of the training rows of sf0.01 showed: texts of a fold fell short by 0.95 at most,
#: those of a language left out of training by 1.49 at least.
LIKELIHOOD_MARGIN = 1.22
#: Bytes of text whose rows advance in step.
STEP_BYTES = 1 << 20
UNDETERMINED = "und"
#: Languages whose counts a training task holds; it hands on those of the others first.
COUNTED_TOGETHER = 12

#: First code points of ranges and the script that they begin.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_RANGE_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_RANGE_SCRIPTS = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = True
    t[128:] = True
    return t


def _folded() -> np.ndarray:
    """Lower-cased letters; every other byte is a space."""
    return np.where(_letters(), V.lower_table(), np.uint8(32))


LETTERS, FOLDED = _letters(), _folded()


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the one-, two- and three-byte grams that end at each byte."""
    b = FOLDED[data].astype(np.uint32)
    one = np.concatenate([[np.uint32(32)], b[:-1]])
    two = np.concatenate([[np.uint32(32)], one[:-1]])
    pair = one << np.uint32(8) | b
    three = ((two << np.uint32(16) | pair) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
    return b, pair + np.uint32(BASES[1]), three + np.uint32(BASES[2])


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the first character of each word."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[starts + i] for i in range(4))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    return _RANGE_SCRIPTS[np.searchsorted(_RANGE_STARTS, point, side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-probabilities, a row for each bucket
    allowed: np.ndarray  # scripts x languages
    usual: np.ndarray  # mean log-probability of a language's training letters in it


def train(docs: DataFrame, chosen: Column, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows for which ``chosen`` holds and whose language is known."""
    rows = docs.where(chosen & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on(k: int) -> pa.RecordBatch:
            total, used = held.pop(k)
            some = np.flatnonzero(total)
            return _counts(k, np.concatenate([some, -1 - np.arange(len(SCRIPTS))]), np.concatenate([total[some], used]))

        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for k in np.unique(own).tolist():
                mine = batch.filter(pa.array(own == k))
                if k not in held and len(held) >= COUNTED_TOGETHER:
                    yield hand_on(next(iter(held)))
                # What was counted last is handed on last.
                total, used = held[k] = held.pop(k, None) or (np.zeros(DIMENSIONS, np.int64), np.zeros(len(SCRIPTS), np.int64))
                for part in V.slices(mine, "text", STEP_BYTES):
                    data, offsets = V.flat(part.column("text"))
                    if not len(data):
                        continue
                    starts, _, _ = V.word_spans(data, offsets, LETTERS)
                    used += np.bincount(scripts_of(data, starts), minlength=len(SCRIPTS))
                    near = _in_words(data)
                    for g in grams(data):
                        total += np.bincount(g[near], minlength=DIMENSIONS)
        while held:
            yield hand_on(next(iter(held)))

    merged = rows.transform(map_batches, count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    k, bucket, n = (merged.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    order = np.argsort(k, kind="stable")
    cut = np.searchsorted(k[order], np.arange(len(languages) + 1))
    used = np.zeros((len(languages), len(SCRIPTS)))
    table = np.zeros((DIMENSIONS, max(1, len(languages))), np.float32)
    usual = np.zeros(max(1, len(languages)))
    for i in range(len(languages)):
        mine = order[cut[i] : cut[i + 1]]
        own, times = bucket[mine], n[mine]
        used[i, -1 - own[own < 0]] = times[own < 0]
        counts = np.zeros(DIMENSIONS)
        counts[own[own >= 0]] = times[own >= 0]
        for a, b in ((BASES[0], BASES[1]), (BASES[1], BASES[2]), (BASES[2], DIMENSIONS)):
            # A bucket that a language has never shown counts as SMOOTHING times.
            part = counts[a:b] + SMOOTHING
            table[a:b, i] = (np.log(part) - np.log(part.sum())) / 2
            usual[i] += (counts[a:b] * table[a:b, i]).sum() / max(counts[a:b].sum(), 1)
    allowed = (used > np.maximum(SCRIPT_SHARE * used.sum(1, keepdims=True), 0)).T
    return Model(languages, table, allowed, usual)


def _counts(k: int, buckets: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])


def _in_words(data: np.ndarray) -> np.ndarray:
    """Letters and the byte after each word."""
    w = LETTERS[data]
    near = w.copy()
    near[1:] |= w[:-1]
    return near


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """Log-probability of each word in each language; languages that don't use its script are out."""
    out = np.empty((len(starts), len(model.languages)), np.float32)
    at = 0
    while at < len(starts):  # bounded runs of words, so that a very long text needs no more memory
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + V.SLICE_BYTES // 2, side="right")))
        a, b = int(starts[at]), min(len(data), int(ends[to - 1]) + 1)
        g1, g2, g3 = grams(data[a:b])
        sums = np.zeros((b - a + 1, len(model.languages)))
        np.cumsum(model.table[g1] + model.table[g2] + model.table[g3], axis=0, out=sums[1:], dtype=np.float64)
        last = np.minimum(ends[at:to] + 1, b) - a
        out[at:to] = sums[last] - sums[starts[at:to] - a]
        at = to
    candidates = model.allowed[scripts_of(data, starts)]
    some = candidates.any(1)
    out[some[:, None] & ~candidates] = -1e4
    out[~some] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best path through each row's words; rows advance together, a word a step."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    states = scores.shape[1]
    back = np.empty(scores.shape, np.min_scalar_type(max(1, states - 1)))
    best = np.zeros((len(order), states), np.float64)
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    own = np.arange(states, dtype=back.dtype)
    for t in range(steps):
        k = active[t]
        v = best[:k]
        top = v.argmax(1)
        switch = v[np.arange(k), top] - penalty
        stay = v >= switch[:, None]
        w = begin[:k] + t
        back[w] = np.where(stay, own, top[:, None].astype(back.dtype))
        best[:k] = np.where(stay, v, switch[:, None]) + scores[w]
    label = np.empty(len(scores), back.dtype)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        w = begin[:k] + t
        label[w] = state[:k]
        state[:k] = back[w, state[:k]]
    return label


def _has_letter(part: pa.RecordBatch, text: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_ = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTERS[data] & (data < 128), out=ascii_[1:])
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in part.column(text)[int(i)].as_py() or "")
    return out


RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = False, min_score: float | None = None, determined: bool = False, min_known: float | None = None) -> DataFrame:
    """docs with lang_pred and lang_score (and ``spans`` of bytes in one language).

    With min_score the columns stay as they are and the rows that are ``und`` or
    score less go.  With determined, letters that are of no learnt language count
    in the score for none.  With min_known the columns stay too, and the rows go
    that are ``und`` or have less than this share of letters in learnt languages,
    one or several.
    """
    filtered = min_score is not None or min_known is not None
    extra = [] if filtered else RESULT + ([T.StructField("spans", SPANS)] if spans else [])
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in extra}]
    schema = T.StructType(kept + extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # A word has a score in each language: with many languages fewer rows go together.
    step = max(1 << 16, STEP_BYTES * 4 // max(4, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            # Texts of like length go together: rows of a slice advance in step.
            batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
            for part in V.slices(batch, text, step):
                pred, score, known, found = predict(part, text, m, spans, determined)
                if filtered:
                    ok = np.array([p != UNDETERMINED for p in pred], bool)
                    ok &= (score >= (min_score or 0)) & (known >= (min_known or 0))
                    yield part.select([f.name for f in kept]).filter(pa.array(ok))
                    continue
                cols = [pa.array(pred, pa.string()), pa.array(score)]
                if spans:
                    cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *cols], names=schema.names)

    return docs.transform(map_batches, run, schema)


def known_letters(scores: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, label: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Letters of each row (rows x languages) that are of the language of their label.

    Words in a script that their language doesn't use are not; nor are those of a
    label whose words in the row are, on average, less likely than LIKELIHOOD_MARGIN allows.
    """
    out = np.zeros((n, len(model.languages)))
    likely, size = np.zeros_like(out), np.zeros_like(out)
    used = model.allowed[scripts_of(data, starts), label]
    at = (row[used], label[used])
    np.add.at(out, at, (ends - starts)[used])
    np.add.at(likely, at, scores[used, label[used]])
    np.add.at(size, at, (ends - starts + 1)[used])
    out[likely < (model.usual - LIKELIHOOD_MARGIN) * size] = 0
    return out


def predict(part: pa.RecordBatch, text: str, model: Model, spans: bool = False, determined: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, list]:
    """(language, score, share of letters in learnt languages, spans) of each row."""
    n = part.num_rows
    data, offsets = V.flat(part.column(text))
    starts, ends, first = V.word_spans(data, offsets, LETTERS)
    if not len(starts) or not model.languages:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n), [[] for _ in range(n)]
    scores = word_scores(data, starts, ends, model)
    label = viterbi(scores, first)
    row = V.row_of(first)
    weight = np.zeros((n, len(model.languages)))
    np.add.at(weight, (row, label), ends - starts)
    of_own = known_letters(scores, data, starts, ends, row, label, n, model)
    letters = _has_letter(part, text, data, offsets)
    total = np.maximum(weight.sum(1), 1)
    known = np.where(letters, of_own.sum(1) / total, 0.0)
    top = weight.argmax(1)
    if determined:
        top = np.where(of_own.any(1), of_own.argmax(1), top)
        weight = of_own
    score = np.where(letters, weight[np.arange(n), top] / total, 0.0)
    pred = [model.languages[t] if ok else UNDETERMINED for t, ok in zip(top, letters, strict=True)]
    found: list = [[] for _ in range(n)]
    if spans:
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(label)) - 1
        for a, b in zip(begin, stop, strict=True):
            found[row[a]].append({"start": int(starts[a] - offsets[row[a]]), "end": int(ends[b] - offsets[row[a]]), "lang": model.languages[label[a]]})
    return pred, score, known, found
