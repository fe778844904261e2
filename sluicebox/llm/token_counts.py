"""Token counts through a digest cache.

A text's count is looked up by the digests of its normalised content and of the
tokenizer's file.  Only texts whose digest has no stored count are encoded, each
distinct one once, and their counts are appended to the cache for later runs.
The only normalisation that cannot change a count is made: null counts as the
empty text.

Defined results: null and empty texts count 0 tokens; equal texts are encoded
once and counted alike, however many rows hold them; other columns are kept and
never looked at; an empty table gives an empty table and adds nothing to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import vectext as V
from .common import map_batches, materialize, shuffle_cleanup
from .segments import SEGMENT_SLICE_BYTES, SegmentMemo, byte_level_memo, word_piece_memo

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@lru_cache(maxsize=4)
def counter(path: str) -> SegmentMemo:
    """Memo that encodes with the library which the file's ending names."""
    if path.endswith(".model"):
        return word_piece_memo(sentencepiece.SentencePieceProcessor(model_file=path))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return byte_level_memo(tok)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _first_texts(df: DataFrame) -> DataFrame:
    """Drop what a task has already sent on: a text with thousands of copies leaves each map task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            mask = []
            for d in batch.column("content_digest").to_pylist():
                mask.append(d not in seen)
                if len(seen) < 1_000_000:  # bounds the task's memory; what slips through is dropped after the shuffle
                    seen.add(d)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.transform(map_batches, run, df.schema)


def _encode_distinct(df: DataFrame, path: str, version: str) -> DataFrame:
    """Counts of the distinct texts; all rows of a digest stand in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = counter(path), set()
        for batch in batches:
            fresh = []
            for i, d in enumerate(batch.column("content_digest").to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            for part in V.slices(batch.take(pa.array(fresh, pa.int64())), "text", SEGMENT_SLICE_BYTES):
                _, offsets = coder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array([version] * part.num_rows), pa.array(np.diff(offsets))], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return df.transform(map_batches, run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs without ``text`` and with n_bytes, n_tokens and over_limit; new counts are appended to the cache."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    texts = docs.select(digest.alias("content_digest"), body.alias("text"))
    misses = _first_texts(texts)
    if not known.isEmpty():
        misses = misses.join(known.select("content_digest"), "content_digest", "left_anti")
    with shuffle_cleanup(spark):
        _encode_distinct(misses.repartition("content_digest"), tokenizer_path, version).write.mode("append").parquet(cache_path)
    # Two runs at once may both store a text; a count depends on nothing but the digests.
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("sb_tokens"))
    # Both sides of the join are then plain reads, so that Spark can split the rows of a digest that very many texts have.
    counts = materialize(counts, "counts")
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*keep).alias("sb_keep"), F.octet_length(body).cast("long").alias("n_bytes"), digest.alias("content_digest"))
    joined = rows.join(counts, "content_digest")
    return joined.select("sb_keep.*", "n_bytes", F.col("sb_tokens").alias("n_tokens"), (F.col("sb_tokens") > limit).alias("over_limit"))
