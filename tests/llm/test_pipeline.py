"""The pipeline on planted rows, stage by stage against brute force."""

import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from sluicebox.llm import bpe, jaccard, simhash, substring
from sluicebox.llm.queries import op6_language, tokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocab = {"en": ["the", "river", "stone", "walked", "there", "which", "having"], "fr": ["été", "maison", "où", "leur", "très", "beaucoup"]}
    text = lambda k, n: " ".join(r.choice(vocab[k]) + r.choice("abcdefgh") * r.randrange(3) for _ in range(n))
    leak, passage = text("en", 14), text("fr", 60)
    rows = [(i, text("en" if i % 2 else "fr", 120), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " fin", "fr"), (102, text("en", 50) + " " + leak + " " + text("en", 40), "en")]
    rows += [(103, text("fr", 40) + " " + passage, "fr"), (104, passage + " " + text("fr", 70), "fr"), (105, "12 34 !!", "en"), (106, None, "en"), (107, "", None)]
    top = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, k, "s", len(t or "")) for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, text("en", 30))], "item_id long, text string").write.parquet(f"file://{top}/benchmark.parquet")
    return f"file://{top}"


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        docs = stage(spark, docs, folder).cache()
        seen[name] = (before, docs.collect())
        assert name == "tokens" or docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name][1]}
    assert ids("language") == {d for d, t in seen["language"][0] if d < 105}
    # The stage's own contract: five words and a similarity of 0.8 (op8's two bits would keep row 101, a copy with a word added).
    assert ids("near_duplicates") == set(brute.similar(seen["near_duplicates"][0]).values()) and not {100, 101} & ids("near_duplicates")
    removed = {x[0]: x for x in brute.substrings(seen["substrings"][0])}
    for r in seen["substrings"][1]:
        assert brute.sha(" ".join(r["text"].split())) == removed[r["doc_id"]][3] and r["n_chars"] == len(r["text"])
    assert removed[103][2] >= 60
    assert ids("decontamination") == ids("substrings") - {102}
    code = bpe.encoding(tokenizer("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    texts = dict(seen["tokens"][0])
    for r in seen["tokens"][1]:
        assert r["n_tokens"] == len(code.encode_ordinary(texts[r["doc_id"]])) and r["decoded_sha256"] == brute.sha(texts[r["doc_id"]])
    assert len(seen["tokens"][1]) == len(texts)


def test_run_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_copies_with_several_edits(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, pairs = [], []
    for i in range(60):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in range(0, 300, 50 if i % 2 else 12):  # six edits or twenty-five
            other[at + 5] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(len(sets(rows[-1][1]) & sets(rows[-2][1])) / len(sets(rows[-1][1]) | sets(rows[-2][1])))
    assert {p >= 0.8 for p in pairs} == {True, False}
    # A list of more than PAIRED_LIST copies of one text, each with one word of its own.
    base = [word() for _ in range(200)]
    rows += [(1000 + i, " ".join([*base[:i], word(), *base[i + 1 :]])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert left == {2 * i for i in range(60)} | {2 * i + 1 for i, p in enumerate(pairs) if p < 0.8} | {1000}


def test_a_group_whose_members_are_alike_but_mostly_not_enough(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4, 6, 9])):
            words[at] = word()
        rows.append((i, " ".join(words)))
    expected = brute.similar(rows)
    assert 3 < len(set(expected.values())) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert left == set(expected.values())


def test_long_lists_lose_no_link(spark, tmp_path):
    rows = []
    for seed in range(3):
        r = random.Random(30 + seed)
        word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
        base = [word() for _ in range(150)]
        for i in range(500):
            words = list(base)
            for at in r.sample(range(150), r.choice([2, 3, 4, 5])):
                words[at] = word()
            rows.append((1000 * seed + i, " ".join(words)))
    expected = brute.similar(rows)
    assert 500 < len(set(expected.values())) < 1300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()}
    assert left == set(expected.values())


def test_near_duplicates_come_by_the_simhash_index_too(spark, tmp_path, monkeypatch):
    # Minwise hashes that find nothing: what SimHash links within two bits and the similarity confirms must go all the same.
    monkeypatch.setattr(jaccard, "_lists", lambda posted, f=jaccard._lists: f(posted.limit(0)))
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(900)]
    other = [f"v{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(other)), (4, " ".join(base))]
    sims = [simhash.majority(jaccard.shingles(t, 5)) for _, t in rows]
    assert 0 < (sims[0] ^ sims[1]).bit_count() <= 2 < ((sims[0] ^ sims[2]) & (1 << 64) - 1).bit_count()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_common_shingles_are_counted_by_products(monkeypatch):
    monkeypatch.setattr(jaccard, "PRODUCT_COLUMNS", 7)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, n)) for n in (0, 1, 5, 30, 30, 59)]
    got = jaccard.common(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    twins = [np.arange(10), np.arange(10), np.arange(9), np.arange(50, 60), np.arange(50, 60)]
    assert len(jaccard.connecting([5, 4, 3, 2, 1], [5, 4, 3, 2, 1], twins, 0.8)) == 3 and jaccard.connecting([5, 4, 3], [7, 7, 7], twins[:3], 0.8) == []


def test_columns_with_the_names_of_inner_ones(spark, tmp_path):
    names = ["sb_digest", "sb_n", "sb_key", "sb_row", "sb_id", "sb_text", "sb_spans", "sb_t", "sb_fp", "sb_bands", "fp", "sb_tk", "sb_kept", "key", "members", "root", "component_id"]
    rows = [(1, "one two " * 40), (2, "one two " * 40), (3, None), (4, "x " * 90)]
    docs = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    for out, left in ((simhash.keep_one(docs), [1, 3, 4]), (simhash.keep_one(docs, size=5, similarity=0.8), [1, 3, 4]), (substring.remove_repeats(docs, replace=True), [1, 2, 3, 4])):
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == left
        assert {r[n] for r in out.collect() for n in names} == {"mine"}
    out = substring.remove_repeats(docs)
    assert out.columns == ["doc_id", *names, "n_words", "n_removed", "kept"] and {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 80, 2: 80, 3: 0, 4: 90}


def test_texts_of_unlearnt_languages_go(spark, tmp_path):
    r = random.Random(6)
    vocab = {
        "en": "the and with thing which house they would there people about river stone".split(),
        "fr": "les une dans pour maison beaucoup leurs toujours quand jardin fleuve pierre".split(),
        "de": "und der nicht häuser schön immer wieder zwischen garten fluss stein werden".split(),
        "fi": "kyllä hyvää päivää metsässä järvellä talossa kaikki yksinkertainen käytännössä".split(),
        "ru": "это дом который быть если когда только".split(),
    }
    text = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    rows = [(i, text(k, 40), k) for i, k in enumerate(["en", "fr", "de"] * 40)]
    junk = " ".join("".join(r.choice("qxzjkvwbgp") for _ in range(7)) for _ in range(40))
    foreign = [(200, text("ru", 30), None), (201, "这是一个没有学过的语言", None), (202, text("fi", 40), None), (203, junk, None), (204, text("en", 10) + " " + text("ru", 40), None)]
    # No language has half the letters, but all letters are in learnt languages.
    clean = [(300, " ".join(text(k, 20) for k in ("en", "fr", "de")), None), (301, text("en", 40) + " " + text("ru", 8), None), (302, "the house", None)]
    docs = spark.createDataFrame(rows + foreign + clean, "doc_id long, text string, lang string")
    left = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    assert left == {d for d, _, _ in rows + clean}
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    score = {x["doc_id"]: x["score"] for x in op6_language(spark, f"file://{tmp_path}").collect()}
    assert all(score[d] < 0.5 for d, _, _ in foreign) and 0.25 < score[300] < 0.5 and 0.5 < score[301] < 0.95 and score[0] == 1
