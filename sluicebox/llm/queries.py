"""The thirteen operators as queries over the whole ``documents`` table, and SQL for those it can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, bpe, decontam, fim, language, media, quality, sharding, simhash, spelling, substring, token_counts, toxicity
from .common import crc32_fold, shared_dir, table


#: The setting that names the folder of stored token counts.
TOKEN_CACHE = "spark.sluicebox.tokenCache"


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; the folder can be set by SLUICEBOX_TOKENIZERS."""
    folder = os.environ.get("SLUICEBOX_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A cache that outlives the run is named by the session; without one the run keeps its own.
    cache = spark.conf.get(TOKEN_CACHE, "") or f"{shared_dir(spark)}/token_counts"
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"), cache)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.features(media.store(docs))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, ~crc32_fold("doc_id", 3, 1))
    rows = language.identify(docs.select("doc_id", "text", crc32_fold("doc_id", 3, 1).alias("held_out")), model, determined=True)
    return rows.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~crc32_fold("doc_id", 4, 2))
    return quality.score(docs.select("doc_id", crc32_fold("doc_id", 4, 2).alias("held_out"), "text"), model)


def op10_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids"
    bitplanes.write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return bitplanes.read_ids(spark, path)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~crc32_fold("doc_id", 3, 1))
    return toxicity.score(docs.select("doc_id", crc32_fold("doc_id", 3, 1).alias("held_out"), "text"), model)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


_ALL = (op1_byte_bpe, op2_token_counts, op3_decontaminate, op4_media, op5_shards, op6_language, op7_substring_dedup, op8_simhash, op9_quality, op10_bitplanes, op11_toxicity, op12_spelling, op13_fill_in_middle)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
        hit AS (
            SELECT doc_id, p, win.n, item_id FROM spots JOIN sizes ON p + sizes.n - 1 <= len(w)
            JOIN win ON win.n = sizes.n AND win.s = array_to_string(list_slice(w, p, p + sizes.n - 1), ' ')),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op5_shards": f"""
        WITH r AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
        levels AS (SELECT doc_id, n_bytes, bits, h >> (60 - bits) AS prefix FROM r, (SELECT unnest(range(0, 61)) AS bits)),
        buckets AS (SELECT bits, prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM levels GROUP BY bits, prefix),
        placed AS (
            SELECT doc_id, n_bytes, bits, prefix, bytes, row_number() OVER (PARTITION BY doc_id ORDER BY bits) AS k
            FROM levels JOIN buckets USING (bits, prefix) WHERE bytes <= {sharding.MAX_SHARD_BYTES})
        SELECT doc_id, n_bytes, CASE WHEN bits = 0 THEN '' ELSE lpad(format('{{:b}}', prefix), CAST(bits AS INTEGER), '0') END || ':0' AS shard, CAST(bits AS INTEGER) AS shard_bits, bytes AS shard_bytes
        FROM placed WHERE k = 1""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
        g AS (
            SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        f AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM g),
        o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM o""",
}
