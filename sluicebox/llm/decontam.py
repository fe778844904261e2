"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows (10 consecutive words, or the whole of a shorter
item) are the sets of the join, their shingles of five words the elements.  A
document contains a window only if it contains all of the window's shingles, so
a prefix of one element is enough: the window's rarest shingle over the whole
corpus.  Document shingles meet these prefixes; the prefix's place in the window
then fixes where the window must start and end (positional and length bounds),
and the words there are compared one by one with the window's.

Windows, shingles, their counts and the choice of the rarest are Spark tables.
Two kinds of things go to the tasks, in blocks of bounded size whatever the
benchmark's: shingle hashes to be counted in a pass over the documents, and
(window, item) pairs with their prefix to be searched for in another.  A window
that very many items share is so many pairs, dealt over the blocks.  Documents
are never shuffled unless the pairs are more than one block.

Defined results: a null or empty text has no words, no hits and no items; items
without words have no windows; repeated items count by their distinct ids, null
ids not at all; equal windows of several items hit for all of them; an empty
benchmark hits nothing; other columns are kept and never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches, materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Bytes of windows and their items that go to the tasks at once, about.
BLOCK_BYTES = 16 << 20
#: Shingle hashes that go to the tasks at once, about.
BLOCK_SHINGLES = 1 << 20


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each row, word hashes)."""
    data, offsets = V.flat(column)
    data = V.lower_table()[data]
    starts, ends, first = V.word_spans(data, offsets, V.alnum_word_table())
    return data, starts, ends, first, V.span_hashes(data, starts, ends)


def item_windows(benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """item_id (string) and each window of the item as its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "text"):
                data, starts, ends, first, _ = words_of(part.column("text"))
                ids, texts = [], []
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    words = [data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
                    size = min(window, len(words))
                    for k in range(len(words) - size + 1 if size else 0):
                        ids.append(item)
                        texts.append(b" ".join(words[k : k + size]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item_id", "window_bytes"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    return rows.transform(map_batches, run, "item_id string, window_bytes binary").distinct()


def shingles(windows: DataFrame) -> DataFrame:
    """Each window's shingles: window_bytes, n (words in the shingle), h and j (its place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = batch.column("window_bytes").to_pylist()
            words = [w.split(b" ") for w in joined]
            raw = np.frombuffer(b"".join(b for w in words for b in w), np.uint8)
            lens = np.array([len(b) for w in words for b in w], np.int64)
            ends = np.cumsum(lens)
            hashes = V.span_hashes(raw, ends - lens, ends)
            at, own, sizes, grams, places = 0, [], [], [], []
            for i, w in enumerate(words):
                n = min(SHINGLE_WORDS, len(w))
                own_grams = V.gram_hashes(hashes[at : at + len(w)], n)
                own.append(np.full(len(own_grams), i))
                sizes.append(np.full(len(own_grams), n, np.int32))
                grams.append(own_grams)
                places.append(np.arange(len(own_grams), dtype=np.int32))
                at += len(w)
            if own:
                yield pa.RecordBatch.from_arrays([batch.column("window_bytes").take(pa.array(np.concatenate(own))), *(pa.array(np.concatenate(x)) for x in (sizes, [g.view(np.int64) for g in grams], places))], names=["window_bytes", "n", "h", "j"])

    return windows.transform(map_batches, run, "window_bytes binary, n int, h long, j int")


class Block:
    """A bounded part of the (window, item) pairs with the windows' prefixes, as arrays that tasks can search."""

    def __init__(self, pairs: pa.Table):
        coded = pairs.column("window_bytes").combine_chunks().dictionary_encode()
        self.windows = coded.dictionary.to_pylist()
        code = np.asarray(coded.indices, np.int64)
        items = pairs.column("item_id").to_pylist()
        order = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[order], np.arange(len(self.windows) + 1))
        self.items = [[items[i] for i in order[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        first = order[cut[:-1]] if len(code) else order
        n, h, j, size = (pairs.column(c).to_numpy()[first] for c in ("n", "h", "j", "size"))
        self.size = size
        #: By the number of words in a shingle: sorted hashes, and the windows and places of each.
        self.prefix = {}
        for words in np.unique(n):
            mine = np.flatnonzero(n == words)
            keys, back = np.unique(h[mine].view(np.uint64), return_inverse=True)
            places: list[list[tuple[int, int]]] = [[] for _ in keys]
            for k, w in zip(back.tolist(), mine.tolist(), strict=True):
                places[k].append((w, int(j[w])))
            self.prefix[int(words)] = (keys, places)


def _blocks_of(rows: DataFrame, n: int, *by: str) -> Iterator[DataFrame]:
    """rows in n parts by a hash."""
    for b in range(n):
        yield rows if n == 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(n)) == b)


def prefixed(benchmark: DataFrame, docs: DataFrame, text: str, window: int = WINDOW_WORDS) -> DataFrame:
    """(window_bytes, item_id) with the window's prefix n, h, j and its words (size); windows of which no document has all shingles are left out."""
    pairs = materialize(item_windows(benchmark, window), "windows")
    elements = materialize(shingles(pairs.select("window_bytes").distinct()), "shingles")
    keys = materialize(elements.select("n", "h").distinct(), "keys")
    counts = None
    for part in _blocks_of(keys, max(1, -(-keys.count() // BLOCK_SHINGLES)), "h"):
        found = shingle_counts(docs, part.toArrow(), text)
        counts = found if counts is None else counts.unionByName(found)
    counted = elements.join(materialize(counts, "counts"), ["n", "h"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rarest = counted.groupBy("window_bytes").agg(F.min(F.struct("c", "h", "j", "n")).alias("p")).where("p.c > 0")
    size = F.size(F.split(F.decode("window_bytes", "UTF-8"), " "))
    return materialize(pairs.join(rarest, "window_bytes").select("window_bytes", "item_id", "p.n", "p.h", "p.j", size.alias("size")), "prefixes")


def _found(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in grams whose hash is one of the sorted keys, and which key."""
    if not len(keys) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A table of the low bits turns most of the search into one look-up.
    bits = np.uint64((1 << 20) - 1)
    low = np.zeros(1 << 20, bool)
    low[keys & bits] = True
    maybe = np.flatnonzero(low[grams & bits])
    k = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
    hit = keys[k] == grams[maybe]
    return maybe[hit], k[hit]


def _inside(first: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of the first positions hold ``size`` words of one row."""
    row = V.row_of(first)
    return row[: n_words - size + 1] == row[size - 1 :] if n_words >= size else np.zeros(0, bool)


def shingle_counts(docs: DataFrame, wanted: pa.Table, text: str) -> DataFrame:
    """How often each wanted shingle (n, h) stands in all documents: c. At most a row for each and task is shuffled."""
    n, h = wanted.column("n").to_numpy(), wanted.column("h").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast({int(k): np.sort(h[n == k]) for k in np.unique(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        total = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
        for batch in batches:
            for part in V.slices(batch, text):
                _, _, _, first, hashes = words_of(part.column(text))
                for n, k in keys.items():
                    at, which = _found(k, V.gram_hashes(hashes, n))
                    which = which[_inside(first, len(hashes), n)[at]] if len(at) else which
                    np.add.at(total[n], which, 1)
        for n, k in keys.items():
            some = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(k[some].view(np.int64)), pa.array(total[n][some])], names=["n", "h", "c"])

    return docs.select(text).transform(map_batches, run, "n int, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c"))


def _hits(part: pa.RecordBatch, text: str, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """(words of each row, positions hit of each row, items of each row)."""
    data, starts, ends, first, hashes = words_of(part.column(text))
    n_words = np.diff(first)
    marks = np.zeros(len(starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    for n, (keys, entries) in block.prefix.items():
        at, which = _found(keys, V.gram_hashes(hashes, n))
        if not len(at):
            continue
        rows = np.searchsorted(first, at, side="right") - 1
        for p, k, row in zip(at.tolist(), which.tolist(), rows.tolist(), strict=True):
            for i, j in entries[k]:
                a, b = p - j, p - j + int(block.size[i])
                if a < first[row] or b > first[row + 1]:
                    continue
                if b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)) == block.windows[i]:
                    marks[a] += 1
                    marks[b] -= 1
                    items[row].update(block.items[i])
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    cut = np.searchsorted(hit, first)
    return n_words, [hit[cut[i] : cut[i + 1]] - first[i] for i in range(part.num_rows)], items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (without text unless keep_text) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    names = [n for n, _ in RESULT]
    keep = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*kept, *(T.StructField(*x) for x in RESULT)])
    pairs = prefixed(benchmark, docs, text)
    weight = pairs.agg(F.sum(F.octet_length("window_bytes") + F.octet_length("item_id") + 16).alias("w")).first()["w"] or 0
    blocks = [*_blocks_of(pairs, max(1, -(-weight // block_bytes)), "window_bytes", "item_id")]
    if len(blocks) > 1:
        return _by_blocks(docs, text, keep, blocks)
    shared = docs.sparkSession.sparkContext.broadcast(Block(pairs.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text):
                n_words, hit, items = _hits(part, text, shared.value)
                n_hit = np.array([len(h) for h in hit], np.int64)
                cols = [part.column(c) for c in keep] + [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items], pa.string()), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).transform(map_batches, run, schema)


def _by_blocks(docs: DataFrame, text: str, keep: list[str], blocks: list[DataFrame]) -> DataFrame:
    """The same for pairs of several blocks: one pass over the documents for each, then hits are joined by text."""
    sc, digest = docs.sparkSession.sparkContext, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = docs.select(digest.alias("sb_text_digest"), F.col(text).alias("sb_text"))
    found = None
    for block in blocks:
        shared = sc.broadcast(Block(block.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in V.slices(batch, "sb_text"):
                    _, hit, items = _hits(part, "sb_text", shared.value)
                    some = [i for i, h in enumerate(hit) if len(h)]
                    yield pa.RecordBatch.from_arrays([part.column("sb_text_digest").take(pa.array(some, pa.int64())), pa.array([hit[i].tolist() for i in some], pa.list_(pa.int64())), pa.array([sorted(items[i]) for i in some], pa.list_(pa.string()))], names=["sb_text_digest", "sb_hit", "sb_items"])

        # Copies of a text have the same hits, so each text's are kept once.
        part = materialize(texts.transform(map_batches, run, "sb_text_digest string, sb_hit array<bigint>, sb_items array<string>").groupBy("sb_text_digest").agg(F.first("sb_hit").alias("sb_hit"), F.first("sb_items").alias("sb_items")), "hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("sb_text_digest").agg(F.size(F.array_distinct(F.flatten(F.collect_list("sb_hit")))).cast("long").alias("sb_n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sb_items")))).alias("sb_items"))
    counted = contamination_words(docs.withColumn("sb_text_digest", digest), text)
    joined = counted.join(merged, "sb_text_digest", "left")
    n_hit, items = F.coalesce("sb_n_hit", F.lit(0)).cast("long"), F.coalesce("sb_items", F.array().cast("array<string>"))
    return joined.select(*keep, F.col("sb_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def contamination_words(docs: DataFrame, text: str) -> DataFrame:
    """docs with sb_n_words, the number of words of each text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("sb_n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, text):
                first = words_of(part.column(text))[3]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first))], names=schema.names)

    return docs.transform(map_batches, run, schema)
