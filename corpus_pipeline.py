"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Language ID drops documents that are not in the learnt languages, SimHash and shingle similarity keep one document
of each group of near duplicates, substring dedup takes out passages that repeat
between the rest, decontamination drops documents that hold benchmark passages,
and byte-level BPE encodes what is left (and decodes it again).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import bpe, decontam, language, simhash, substring
from sluicebox.llm.common import crc32_fold, stage_result, table
from sluicebox.llm.queries import tokenizer

#: A document goes if less than this share of its letters is in learnt languages.
MIN_LANGUAGE_SHARE = 0.5
#: Near duplicates share this much (Jaccard) of their shingles of so many words.
NEAR_SIMILARITY = 0.8
NEAR_WORDS = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in the learnt languages, one or several; texts without a letter and those of other languages go."""
    model = language.train(docs, ~crc32_fold("doc_id", 3, 1))
    return language.identify(docs, model, min_known=MIN_LANGUAGE_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of the smallest doc_id.

    SimHash's index of positional bytes gives the links within two bits, each
    verified by the exact similarity; minwise hashes add those farther apart.
    """
    return simhash.keep_one(docs, size=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages of 35 words or more that stand more than once are taken out of their texts."""
    left = substring.remove_repeats(docs, replace=True)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of any benchmark item."""
    marked = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=True)
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: SQL has no byte-level BPE, Viterbi or SimHash; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        docs = stage_result(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
