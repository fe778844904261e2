"""Substring deduplication on a log-structured fingerprint index.

A window is 35 consecutive words.  Its fingerprint is the smallest hash of the
8-word grams in it, so equal windows have equal fingerprints, and neighbouring
windows mostly share one: an entry stands for a run of windows of one document
whose smallest gram is the same occurrence.  About one word in fifteen begins an
entry, yet every window is in one.

Each batch of documents becomes an immutable run of the index: its fingerprints
and how often each stands, a table bucketed and sorted by fingerprint.  The
counts are summed before they are dealt out, so that a fingerprint of a third of
all entries is a row like any other.  A new batch is merge-joined with the runs
before it, bucket by bucket and without a shuffle, to find fingerprints that
stand more than once; runs are compacted into one when there are several.  The
entries themselves stay as their tasks wrote them until the repeated ones among
them are taken out.

A shared fingerprint is only a candidate.  Entries are verified by a second
digest of all the words that their windows cover: entries that agree in it
repeat as a whole.  The others (edges of copies) are verified window by window,
by the digest of each window's words, against one entry of each different text.

Defined results: null and empty texts have no words; a document of fewer words
than a window keeps all; a repeated row's windows occur twice; other columns
are kept and never looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import map_batches, materialize, shuffle_cleanup, text_key

WINDOW_WORDS = 35
GRAM_WORDS = 8
#: Runs that are merged into one.
FAN_IN = 4


def spaced_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): all words, each with one space after it, and each row's first word."""
    data, offsets = V.flat(column)
    starts, ends, first = V.word_spans(data, offsets, V.space_word_table())
    lengths = ends - starts
    after = np.cumsum(lengths + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[after - 1] = False
    out[inside] = data[V.space_word_table()[data]]
    return out, after - 1 - lengths, after - 1, first


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, first and last window) of each entry; windows are numbered by their first word."""
    none = np.zeros(0, np.int64)
    n = len(starts) - window + 1
    if n <= 0:
        return none, none, none, none
    row = V.row_of(first)
    hashes = V.gram_hashes(V.span_hashes(data, starts, ends), gram)
    within = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(within):
        return none, none, none, none
    span = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    smallest = np.concatenate([view[a : a + 65536].argmin(1) for a in range(0, n, 65536)]) + np.arange(n)
    at, own = smallest[within], row[within]
    new = np.ones(len(within), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(within)) - 1
    return own[begin], hashes[at[begin]].view(np.int64), within[begin], within[last]


class FingerprintIndex:
    """Sorted immutable runs of the window fingerprints of all documents so far, and the entries behind them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, fan_in: int = FAN_IN):
        self.spark, self.window, self.gram, self.fan_in = spark, window, min(gram, window), fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.parts: list[str] = []

    def _name(self, kind: str) -> str:
        return f"sluicebox_{kind}_{uuid.uuid4().hex}"

    def _write(self, counts: DataFrame) -> str:
        """A run of the counts (fp, n), which are one row for each fingerprint."""
        name = self._name("run")
        # Dealt out by the buckets' own hash, each bucket is one sorted file.
        with shuffle_cleanup(self.spark):
            counts.repartition(self.buckets, "fp").write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def entries(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """fp, ctx (digest of all words of the entry's windows), sb_key, sb_tk, s1 and s2 (first and last window)."""
        rows = docs.select(F.col(key).alias("sb_key"), text_key(text).alias("sb_tk"), F.col(text).alias("sb_text"))
        schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("ctx", T.LongType()), rows.schema["sb_key"], rows.schema["sb_tk"], T.StructField("s1", T.IntegerType()), T.StructField("s2", T.IntegerType())])
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_64_intdigest
            for batch in batches:
                for part in V.slices(batch, "sb_text"):
                    data, starts, ends, first = spaced_words(part.column("sb_text"))
                    row, fp, a, b = windows(data, starts, ends, first, window, gram)
                    if not len(row):
                        continue
                    raw = data.tobytes()
                    ctx = np.array([digest(raw[x:y]) for x, y in zip(starts[a].tolist(), ends[b + window - 1].tolist(), strict=True)], np.uint64).view(np.int64)
                    at = pa.array(row)
                    base = first[row]
                    yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ctx), part.column("sb_key").take(at), part.column("sb_tk").take(at), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], names=schema.names)

        return rows.transform(map_batches, run, schema)

    def ingest(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch as a run; the fingerprints (fp) that it repeats, within itself or from earlier runs."""
        part = self._name("entries")
        self.entries(docs, key, text).write.format("parquet").option("compression", "zstd").saveAsTable(part)
        self.parts.append(part)
        name = self._write(self.spark.table(part).groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
        own = self.spark.table(name)
        hits = own.where("n > 1").select("fp")
        for run in self.runs:
            hits = hits.unionByName(own.hint("merge").join(self.spark.table(run), "fp").select("fp"))
        hits = materialize(hits.distinct(), "hits")
        self.runs.append(name)
        if len(self.runs) >= self.fan_in:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            merged = self._write(self._all(self.runs).groupBy("fp").agg(F.sum("n").alias("n")))
            for run in self.runs:
                self._drop(run)
            self.runs = [merged]

    def _all(self, tables: list[str]) -> DataFrame:
        out = self.spark.table(tables[0])
        for more in tables[1:]:
            out = out.unionByName(self.spark.table(more))
        return out

    def candidates(self, hits: DataFrame) -> DataFrame:
        """Entries of all batches whose fingerprint is among the hits; a hot fingerprint's can be split over many tasks."""
        return self._all(self.parts).join(hits.hint("merge"), "fp", "left_semi")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        for name in self.runs + self.parts:
            self._drop(name)
        self.runs, self.parts = [], []


def _window_digests(docs: DataFrame, wanted: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """The digest of each window of the wanted entries (sb_key, sb_tk, sb_w: open, s1, s2)."""
    grouped = wanted.groupBy("sb_key", "sb_tk").agg(F.collect_set(F.struct("open", "s1", "s2")).alias("sb_w"))
    rows = docs.select(F.col(key).alias("sb_k"), text_key(text).alias("sb_t"), F.col(text).alias("sb_text"))
    joined = rows.join(grouped, rows["sb_k"].eqNullSafe(grouped["sb_key"]) & (rows["sb_t"] == grouped["sb_tk"])).select("sb_key", "sb_tk", "sb_text", "sb_w")
    schema = T.StructType([T.StructField("w", T.BinaryType()), T.StructField("open", T.BooleanType()), joined.schema["sb_key"], joined.schema["sb_tk"], T.StructField("s", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                data, starts, ends, first = spaced_words(part.column("sb_text"))
                raw = data.tobytes()
                rows, w, opens, at = [], [], [], []
                for i, spans in enumerate(part.column("sb_w").to_pylist()):
                    for s in spans:
                        for p in range(s["s1"], s["s2"] + 1):
                            q = first[i] + p
                            w.append(digest(raw[starts[q] : ends[q + window - 1]]))
                            rows.append(i)
                            opens.append(s["open"])
                            at.append(p)
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(opens, pa.bool_()), part.column("sb_key").take(index), part.column("sb_tk").take(index), pa.array(at, pa.int32())], names=schema.names)

    return joined.transform(map_batches, run, schema)


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """sb_key, sb_tk, s1 and s2: runs of windows whose words also start elsewhere.

    docs come to the index as so many batches, dealt by a hash of the id; the
    runs are compacted into one when the last has come.
    """
    index = index or FingerprintIndex(docs.sparkSession, window=window, fan_in=batches)
    hits = None
    for b in range(batches):
        found = index.ingest(docs.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b), key, text)
        hits = found if hits is None else hits.unionByName(found)
    found = materialize(index.candidates(hits.distinct()), "candidates")
    index.drop()
    texts = found.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sb_key", "sb_tk", "s1", "s2")).alias("one"))
    texts = materialize(texts, "texts")
    whole = found.join(texts.where("n > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi").select("sb_key", "sb_tk", "s1", "s2")
    # Where a fingerprint stands in different surroundings, windows of the lone ones may still be equal to others.
    several = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1").select("fp")
    wanted = texts.join(several, "fp", "left_semi").select("one.sb_key", "one.sb_tk", "one.s1", "one.s2", (F.col("n") == 1).alias("open"))
    # A repeated row gives its windows twice, but all its entries are whole already, so nothing open is added.
    digests = materialize(_window_digests(docs, wanted, key, text, window), "digests")
    # A plain read on both sides: Spark can split the entries of a window that very many texts have.
    twice = materialize(digests.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"), "twice")
    single = digests.where("open").join(twice, "w", "left_semi").select("sb_key", "sb_tk", F.col("s").alias("s1"), F.col("s").alias("s2"))
    return whole.unionByName(single)


REMOVED = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, batches: int = 2, replace: bool = False) -> DataFrame:
    """docs without text, with n_words, n_removed and kept (the words left, joined by one space).

    With replace the columns stay as they are; a text that loses words is what is left of it.
    """
    spans = repeated_windows(docs, key, text, window, batches)
    spans = spans.groupBy("sb_key", "sb_tk").agg(F.collect_set(F.struct("s1", "s2")).alias("sb_spans"))
    # The user's other columns stand in one, so that none has the name of one of ours.
    others = [F.col(c) for c in docs.columns if c != text] or [F.lit(0).alias("sb_none")]
    rows = docs.select(F.struct(*others).alias("sb_row"), F.col(key).alias("sb_id"), F.col(text).alias("sb_text"), text_key(text).alias("sb_t"))
    joined = rows.join(spans, rows["sb_id"].eqNullSafe(spans["sb_key"]) & (rows["sb_t"] == spans["sb_tk"]), "left").select("sb_row", "sb_text", "sb_spans")
    schema = T.StructType([joined.schema["sb_row"], T.StructField("kept", T.StringType()), *REMOVED[:2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                texts = part.column("sb_text")
                data, starts, ends, first = spaced_words(texts)
                gone = np.zeros(len(starts) + 1, np.int64)
                for i, spans in enumerate(part.column("sb_spans").to_pylist()):
                    for s in spans or ():
                        gone[first[i] + s["s1"]] += 1
                        gone[first[i] + s["s2"] + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                n_removed = lost[first[1:]] - lost[first[:-1]]
                left, size = _left(data, starts, ends, first, gone)
                kept = [left[a:b] for a, b in size]
                if replace:
                    kept = [old if not n else new.decode() for old, new, n in zip(texts.to_pylist(), kept, n_removed, strict=True)]
                kept = pa.array(kept, pa.string()) if replace else pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("sb_row"), kept, pa.array(np.diff(first)), pa.array(n_removed)], names=schema.names)

    done, own = joined.transform(map_batches, run, schema), F.col("sb_row")
    if replace:
        return done.select(*[F.col("kept").alias(c) if c == text else own[c].alias(c) for c in docs.columns])
    names = {f.name for f in REMOVED} | {text}
    return done.select(*[own[c].alias(c) for c in docs.columns if c not in names], *[f.name for f in REMOVED])


def _left(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of the words left, and where each row's are."""
    lengths = ends - starts + 1
    stay = np.repeat(~gone, lengths)
    sizes = np.concatenate([[0], np.cumsum(np.where(gone, 0, lengths))])
    begin, stop = sizes[first[:-1]], sizes[first[1:]]
    return data[stay].tobytes(), [(a, max(a, b - 1)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
