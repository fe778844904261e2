"""Tokenizer operators against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluicebox.llm import bitplanes, bpe, token_counts

TEXTS = [
    None,
    "",
    " ",
    "a",
    "plain words here",
    "  two  spaces and\ttabs \n\n new lines ",
    "it's 12,345 don't — naïve café ☃ 日本語のテキスト   nbsp",
    "▁mark ▁ and marks▁",
    "<|endoftext|> and <s> </s> <unk>",
    "word " * 300,
    "x" * 700 + " " + "!" * 400 + "   " * 200 + "end",
    "The quick brown fox. " * 100,
    "Ünïcödé wide　space\u0085next " * 40,
    "The quick brown fox. " * 100,
]


def table(spark, texts=TEXTS):
    # The extra columns have names that the operators use inside.
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_bytes long")


@pytest.fixture(scope="module")
def multi():
    return bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 2048), (64, 16), (40, 30)])
def test_bpe_is_the_librarys_and_decodes_to_the_text(spark, multi, chunk, overlap):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark)
    rows = bpe.decode(bpe.encode(docs, ranks, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap), ranks).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == multi.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


@pytest.mark.parametrize("block,overlap", [(100, 60), (300, 40)])
def test_blocks_of_long_texts_are_stitched_or_merged(spark, multi, block, overlap):
    ranks, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(3)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "'", "l", "'re", "1", "23", "!", "日", "7" * 60, " " * 90, "x" * 150]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(40)] + [None, "", "7" * 2000, "x" * 999 + " y", "ab " * 500]
    docs = spark.createDataFrame([(i, t, "k", b"q") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary")
    rows = bpe.decode(bpe.encode(docs, ranks, P.PATTERN, chunk_chars=40, overlap_chars=30, block_chars=block, block_overlap=overlap), ranks).collect()
    assert len(rows) == len(texts)
    for x in rows:
        text = texts[x["doc_id"]] or ""
        assert np.frombuffer(x["ids"], "<u4").tolist() == multi.encode_ordinary(text) and bytes(x["decoded"]) == text.encode()


@pytest.mark.parametrize("size,overlap", [(12, 10), (40, 30), (100, 60)])
def test_chunks_are_stitched_to_the_librarys_pieces(multi, size, overlap):
    r = random.Random(size)
    newer = bpe.newer_characters()
    split = bpe.pre_tokenizer(P.PATTERN, newer)
    coder = bpe.memo(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, newer, size, overlap)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "\t", "'", "l", "'re", "1", "23", "!", "..", "日", "\u3000", "\xa0", "\U000107bb", "\U00032000", "x" * 40, "7" * 50, " " * 30, "'s ", "don't"]
    for _ in range(1500):
        some = r.choice([alphabet, ["a", " ", "b'"], ["\n", " ", "x"], ["'", "l", "r", "e"]])
        text = "".join(r.choice(some) for _ in range(r.randrange(1, 200)))
        assert bpe.stitched(text, split, size, overlap) == split(text)
        assert np.frombuffer(coder.one(text), "<u4").tolist() == multi.encode_ordinary(text)


SPACES = [" \xa0", "\u3000", "\r\n", "\t\t ", " \n \xa0", "\x85\u2003 "]


@pytest.mark.parametrize("space", SPACES)
def test_white_space_at_every_offset_around_a_stitch(multi, space):
    coder = bpe.memo(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for at in range(bpe.CHUNK_CHARS - 40, bpe.CHUNK_CHARS + bpe.OVERLAP_CHARS + 40, 3):
        for unit in ("word ", "a", "b's 1 "):
            text = (unit * 3000)[:at] + space + "word" + space + "7 more" + space * 2 + "it's " + unit * 900
            assert np.frombuffer(coder.one(text), "<u4").tolist() == multi.encode_ordinary(text)


def test_white_space_at_offsets_around_a_blocks_end(spark, multi):
    ranks, block = P.path("byte_bpe_multi_50k.tiktoken"), bpe.BLOCK_CHARS
    texts = [("some words " * 9000)[: block + d] + (space + "word") * 40 + " rest" * 900 for space in SPACES for d in range(-13, 3000, 311)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for x in bpe.encode(docs, ranks, P.PATTERN).collect():
        assert np.frombuffer(x["ids"], "<u4").tolist() == multi.encode_ordinary(texts[x["doc_id"]])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é'\n\t .,1日▁　", max_size=120), min_size=1, max_size=4))
def test_segments_agree_with_the_library(multi, texts):
    import pyarrow as pa

    ids, offsets = bpe.memo(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [multi.encode_ordinary(t) for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids, offsets = token_counts.counter(P.path("piece_bpe_32k.model")).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == model.encode(texts)


def test_bpe_of_an_empty_table(spark):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.digests(bpe.decode(bpe.encode(table(spark, [])["doc_id", "text"], ranks, P.PATTERN), ranks)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_librarys_and_are_cached(spark, tmp_path, name):
    path, cache = P.path(name), f"file://{tmp_path}/cache"
    if name.endswith("model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = token_counts.count_tokens(table(spark), path, cache, limit=300).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == [(i, len((t or "").encode()), count(t or ""), count(t or "") > 300) for i, t in enumerate(TEXTS)]
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS})
    again = token_counts.count_tokens(table(spark, [*TEXTS, "one more text"]), path, cache)
    assert again.count() == len(TEXTS) + 1
    assert spark.read.parquet(cache).count() == stored + 1


def test_counts_of_an_empty_table(spark, tmp_path):
    assert token_counts.count_tokens(table(spark, []), P.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("byte", 50), ("bit", 50)])
def test_ids_are_written_and_read_in_order(spark, tmp_path, kind, block):
    path, out = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids"
    tok = Tokenizer.from_file(path)
    bitplanes.write_ids(table(spark).repartition(3), path, out, kind=kind, block_ids=block)
    rows = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in bitplanes.read_ids(spark, out).collect()}
    start, expected = 0, {}
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows == expected


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint32)
    assert np.array_equal(bitplanes.from_planes(bitplanes.to_planes(ids, kind), 1003, kind), ids)


def test_ids_of_an_empty_table_and_of_repeated_rows(spark, tmp_path):
    path = P.path("byte_bpe_50k.json")
    bitplanes.write_ids(table(spark, []), path, f"file://{tmp_path}/a")
    assert bitplanes.read_ids(spark, f"file://{tmp_path}/a").count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a b"), (1, "b"), (None, "n")], "doc_id long, text string")
    bitplanes.write_ids(twice, path, f"file://{tmp_path}/b")
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in bitplanes.read_ids(spark, f"file://{tmp_path}/b").collect())
    assert [r[1] for r in rows] == [None, 1, 1, 1] and sum(r[2] for r in rows) == 2 + 2 + 3 + 2




def test_rows_of_one_id_are_written_by_several_tasks(spark, tmp_path):
    path, out, key = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/hot", "spark.sql.adaptive.coalescePartitions.enabled"
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set(key, "false")
    try:
        bitplanes.write_ids(docs, path, out)
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(out).select("part").distinct().count() > 1
    rows = bitplanes.read_ids(spark, out).collect()
    assert len(rows) == 400 and len({r["start"] for r in rows}) == 400 and {r["doc_id"] for r in rows} == {7}
