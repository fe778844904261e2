"""Each query of the subpackage over a small folder of tables, against brute force and the libraries."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicebox.llm import bpe, language, media, quality, sharding, token_counts
from sluicebox.llm import queries as Q
from sluicebox.llm.common import crc32_fold

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, sb_row int, ids string, score string, spans string, lang_pred int, fp int, page int, kept string"


def rows_of():
    r = random.Random(21)
    vocab = {"en": "the river stone walked there which having people about would".split(), "fr": "été maison où leur très beaucoup les dans pour toujours".split()}
    text = lambda k, n: " ".join(r.choice(vocab[k]) + r.choice(["", "s", ",", "."]) + str(r.randrange(30)) * r.randrange(2) for _ in range(n))
    leak, passage = text("en", 14), text("fr", 60)
    rows = [(i, text("en" if i % 2 else "fr", 20 + 3 * i), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, rows[3][1], "en"), (101, rows[5][1] + " end", "en"), (102, leak + " " + text("en", 30), "en"), (103, passage + text("fr", 9), "fr"), (104, text("fr", 5) + passage, "fr")]
    rows += [(105, None, "en"), (106, "", None), (107, " \n", "fr"), (108, "12 34 !!", "en"), (109, "tie", "en"), (110, "tie", "en")]
    rows += [(111, text("en", 30000) + " " + leak + " " + passage, "en"), (112, "x" * 90000 + " " + "7" * 70000, "en")]
    return rows, leak


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, leak = rows_of()
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.createDataFrame([(d, t, k, "s", len(t or ""), *[None] * 8) for d, t, k in rows], DOCUMENTS)
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "tie"), (3, None), (4, "none such words at all in any of the texts here")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d, _, _ in rows if d < 60] + [(60, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, {d: t for d, t, _ in rows}


def collected(spark, tables, name):
    rows = getattr(Q, name)(spark, tables[0]).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(tables[1])
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, tables):
    code = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for d, r in collected(spark, tables, "op1_byte_bpe").items():
        ids = code.encode_ordinary(tables[1][d] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tables[1][d] or ""))


def test_op2_and_a_second_run_from_the_stored_counts(spark, tables, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    spark.conf.set(Q.TOKEN_CACHE, f"file://{tmp_path}/counts")
    try:
        for again in range(2):
            for d, r in collected(spark, tables, "op2_token_counts").items():
                n = len(model.encode(tables[1][d] or ""))
                assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((tables[1][d] or "").encode()), n, n > 4096)
            stored = spark.read.parquet(f"file://{tmp_path}/counts").count()
            assert stored == len({t or "" for t in tables[1].values()})
    finally:
        spark.conf.unset(Q.TOKEN_CACHE)


def test_op3(spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").collect()]
    expected = brute.decontam(list(tables[1].items()), items)
    got = collected(spark, tables, "op3_decontaminate")
    assert {d: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for d, r in got.items()} == expected
    assert expected[102][4] and expected[111][4] and expected[109][4]


def test_op4(spark, tables):
    for d, r in collected(spark, tables, "op4_media").items():
        raw = (tables[1][d] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-16:]))
        assert (r["media_sha256"], r["media_type"], r["type_corrected"], r["carved"]) == (brute.sha(media.wav_of(payload)), "audio/wav", True, [])


def test_op5(spark, tables):
    got = collected(spark, tables, "op5_shards")
    assert all(r["n_bytes"] == len((tables[1][d] or "").encode()) and r["shard_bytes"] <= sharding.MAX_SHARD_BYTES for d, r in got.items())


def test_op6(spark, tables):
    got = collected(spark, tables, "op6_language")
    for d, r in got.items():
        assert set(r.asDict()) == {"doc_id", "held_out", "lang_pred", "score"} and r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if d < 60:
            assert r["lang_pred"] == ("en" if d % 2 else "fr")
    assert {got[d]["lang_pred"] for d in (105, 106, 107, 108)} == {"und"} and got[111]["lang_pred"] == "en"


def test_op7(spark, tables):
    got = collected(spark, tables, "op7_substring_dedup")
    assert sorted(((d, r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()), key=str) == brute.substrings(list(tables[1].items()))


def test_op8(spark, tables):
    prints = [(d, brute.simhash(t)) for d, t in tables[1].items()]
    roots = brute.components(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in collected(spark, tables, "op8_simhash").items()} == {d: (f"{f:016x}", roots[d]) for d, f in prints}


def test_op9(spark, tables):
    got = collected(spark, tables, "op9_quality")
    for d, r in got.items():
        assert set(r.asDict()) == {"doc_id", "held_out", "score", "predicted"} and r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert got[105]["score"] == got[106]["score"]


def test_op10(spark, tables):
    tok, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = collected(spark, tables, "op10_bitplanes")
    for d in sorted(got):
        ids = [*tok.encode(tables[1][d] or "", add_special_tokens=False).ids, 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_all_queries_of_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name, query in Q.QUERIES.items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name


def test_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(None, "no id here", "en"), (None, "no id here", "en"), (1, "the house", "en"), (1, "the house", "en"), (2, None, None)]
    docs = spark.createDataFrame([(*r, "mine", 5, "s") for r in rows], "doc_id long, text string, lang string, spans string, lang_pred int, score string")
    model = language.train(docs, F.lit(True))
    out = language.identify(docs, model, spans=True)
    assert out.count() == 5 and out.columns.count("spans") == 1 and {r["lang_pred"] for r in out.collect()} == {"en", "und"}
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels, F.lit(True)))
    assert scored.count() == 5 and scored.columns.count("score") == 1 and dict(scored.dtypes)["score"] == "double"
    placed = sharding.assign(docs.withColumn("shard", F.lit("x")), 12, carry=["lang", "shard"])
    assert placed.count() == 5 and placed.columns == ["lang", "doc_id", "n_bytes", "shard", "shard_bits", "shard_bytes"]
    assert docs.where(crc32_fold("doc_id", 3, 1)).count() >= 0
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.digests(bpe.encode(docs, ranks, P.PATTERN, decoded="decoded")).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in coded) == sorted((str(d), brute.sha(t or "")) for d, t, _ in rows)
    counted = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/counts").collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in counted) == sorted((str(d), len(t or "")) for d, t, _ in rows) and {r["n_tokens"] for r in counted if r["doc_id"] == 2} == {0}


def test_more_languages_than_a_task_counts_together(spark):
    r = random.Random(2)
    made = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)] for k in range(270)}
    rows = [(i * 270 + j, " ".join(r.choice(words) for _ in range(25)), k) for i in range(2) for j, (k, words) in enumerate(made.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    out = language.identify(docs, language.train(docs, F.lit(True))).collect()
    assert sum(x["lang_pred"] == x["lang"] for x in out) >= 0.99 * len(rows)


def plain_features(text):
    """The n-grams of a text from the description alone: words, word pairs, shapes of four bytes."""
    table = {**{b: "a" for b in [*range(97, 123), *range(128, 256)]}, **{b: "A" for b in range(65, 91)}, **{b: "0" for b in range(48, 58)}, **{b: " " for b in range(9, 14)}}
    words = [w.lower() for w in brute.re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shape = [table.get(b, chr(b)) for b in (text or "").encode()]
    pairs = {("pair", "again") if a == b else ("pair", a, b) for a, b in zip(words, words[1:])}
    return {("word", w) for w in words} | pairs | {("shape", *shape[i : i + 4]) for i in range(len(shape) - 3)}


def test_features_are_the_distinct_ngrams():
    import pyarrow as pa

    texts = ["", None, "a", "Ab 12 ab, ab ab", "same same same", "ünïcode 7!", "x\ty\nz  \n", "the quick Brown fox 99 jumps. THE end"]
    _, offsets = quality.features(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(plain_features(t)) for t in texts]
    # Equal n-grams have equal buckets, and others do not (in texts this small).
    buckets, offsets = quality.features(pa.array(["alpha beta", "gamma beta", "alpha beta"]))
    one, two, three = (set(buckets[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:]))
    assert one == three and len(one & two) == len(plain_features("alpha beta") & plain_features("gamma beta"))


def test_the_fit_is_the_dual_optimum_of_the_hinge_loss():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 40, 9)) for _ in range(60)]
    y = np.where(np.array([(x < 20).sum() for x in rows]) + r.normal(0, 1.5, 60) > 4, 1, -1)
    values = [r.normal(1, 0.3, len(x)) for x in rows]
    values = [v / np.sqrt((v * v).sum()) for v in values]
    w, b = quality.descend(rows, values, y, 40)
    cost = quality.COST * np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    dense = np.zeros((60, 41))
    for i, (x, v) in enumerate(zip(rows, values)):
        dense[i, x], dense[i, 40] = v, 1  # the bias is a feature that is always on
    loss = lambda u: (u @ u) / 2 + (cost * np.maximum(0, 1 - y * (dense @ u))).sum()
    # Projected gradient on the dual, many small steps.
    gram, alpha = (dense @ dense.T) * np.outer(y, y), np.zeros(60)
    for _ in range(20000):
        alpha = np.clip(alpha - 0.01 * (gram @ alpha - 1), 0, cost)
    best = loss(dense.T @ (alpha * y))
    assert best - 1e-6 <= loss(np.append(w, b)) <= best * 1.02


def test_ratios_are_of_class_counts():
    rows, y = [np.array([0, 1]), np.array([1, 2]), np.array([2, 3]), np.array([0, 3]), np.array([0, 1, 3])], [1, 1, -1, -1, 1]
    model = quality.fit(rows * 3, np.array(y * 3))
    early = [i for i in range(15) if i % quality.CURVE_EVERY != quality.CURVE_EVERY - 1]
    counts = {s: np.full(1 << quality.BUCKET_BITS, quality.SMOOTHING) for s in (1, -1)}
    for i in early:
        for f in rows[i % 5]:
            counts[y[i % 5]][f] += 1
    expected = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    assert np.allclose(model.ratios, expected)


def test_digest_of_nothing():
    assert brute.sha("") == hashlib.sha256(b"").hexdigest()
