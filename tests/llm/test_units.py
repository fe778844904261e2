"""Fill-in-middle, toxicity and spelling variants against brute force from their contracts, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import fim, spelling, toxicity
from sluicebox.llm import queries as Q

EDGES = [(900, None), (901, ""), (902, "\n"), (903, "é"), (904, "日本語 and 🦆🦆"), (905, "has a <S> in it"), (906, "<P>"), (None, "no id at all"), (None, "no id at all"), (907, "tie"), (907, "tie"), (908, "<" * 50 + "P" + ">" * 20)]


def fim_row(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_is_the_plain_version_and_restores_exactly(spark):
    r = random.Random(4)
    alphabet = ["a", "b ", "é", "日", "\n", "🦆", "<", "P>", "<M", "x" * 30]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(80)))) for i in range(400)] + EDGES
    docs = spark.createDataFrame([(d, t, "mine", 7, 8, "k") for d, t in rows], "doc_id long, text string, output string, n int, own int, sb_none string").repartition(3)
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "own", "sb_none", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    for x in got:
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == fim_row(x["doc_id"], x["text"]) and x["back"] == (x["text"] or "")
    assert {x["form"] for x in got} == {"plain", "psm", "spm"} and out.count() == len(rows)
    assert sorted(r["output"] for r in out.where("doc_id is null").collect()) == [fim_row(None, "no id at all")[4]] * 2


@pytest.mark.parametrize("size", [7, 1000])
def test_long_texts_are_cut_in_blocks(monkeypatch, size):
    monkeypatch.setattr(fim, "SLICE_BYTES", size)
    text = "aé日🦆\n" * 300
    for a, b in [(0, 0), (0, 1500), (1500, 1500), (3, 4), (700, 1203)]:
        for form, expected in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), ("plain", text)):
            got = fim.rearranged(pa.array([text]), pa.array([form]), pa.array([a], pa.int64()), pa.array([b], pa.int64()))
            assert got.to_pylist() == [expected]


def test_fill_in_middle_without_other_columns_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.transform(none)).count() == 0
    only = spark.createDataFrame([("abc",)], "text string").select(F.col("text"), F.lit(1).alias("doc_id"))
    assert fim.transform(only).select("output").collect()[0][0] == fim_row(1, "abc")[4]


def vocabulary(rows, least=3):
    count = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(brute.AZ)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(links[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def made(seed, n, alphabet, sizes):
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.choice(sizes))): r.choice([3, 3, 4, 6, 6, 12, 30, 100]) for _ in range(n)}


@pytest.mark.parametrize("words,chars", [
    (made(1, 250, "ab", [5, 6, 7, 8]), 100_000),
    (made(1, 250, "ab", [5, 6, 7, 8]), 20),
    (made(2, 300, "abÿ÷c", [5, 5, 6]), 60),
    ({**made(3, 30, "xy", [5, 40, 41]), "a" * 3000: 9, "a" * 2999: 3, "a" * 1500 + "b" + "a" * 1499: 4, "b" + "a" * 2998: 3}, 4000),
])
def test_variants_are_those_of_brute_force(spark, words, chars):
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(table, partition_chars=chars).collect()}
    assert got == variants(words)


def test_each_pair_is_accepted_once_in_each_direction(spark):
    words = made(5, 200, "abc", [5, 6, 7])
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for chars in (30, 100_000):
        got = [(r["word"], r["near"], r["near_n"]) for r in spelling.pairs(table, chars).collect()]
        assert sorted(got) == sorted((a, b, words[b]) for a in words for b in words if near(a, b))


def test_spelling_query_over_documents(spark, tmp_path):
    r = random.Random(8)
    stems = ["häuser", "colour", "color", "gärten", "Garden", "wörter", "spelling"]
    rows = [(i, " ".join(r.choice(stems) + r.choice(["", "", "s", "×x", "2", "-"]) for _ in range(60))) for i in range(120)] + EDGES
    docs = spark.createDataFrame([(d, t, 1, "n", "w") for d, t in rows], "doc_id long, text string, n int, word string, run string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in Q.op12_spelling(spark, f"file://{tmp_path}").collect()}
    assert got == variants(vocabulary(rows)) and any(v[0] for v in got.values()) and max(len(w) for w in got) == 10


def test_acceptors_are_minimal():
    words = sorted({"".join(w) for w in ("stop", "stops", "top", "tops", "slop", "slops", "a", "")})
    machine = spelling.Acceptors()
    start = machine.build(words)

    def language(state):
        return frozenset(([""] if machine.ends[state] else []) + [c + rest for c, s in machine.arcs[state].items() for rest in language(s)])

    assert language(start) == frozenset(words)
    # No two states accept the same rest.
    assert len({language(s) for s in range(len(machine.ends))}) == len(machine.ends)


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(100)] + [("x", "w50")], "word string, form string")
    assert {r["root"] for r in spelling.roots(chain).collect()} == {"w100"}


def grams(text):
    words = [w.translate(brute.AZ) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    return {(g, tuple(words[i + d] for d in (0, *g))) for g in toxicity.GRAMS for i in range(len(words)) if i + max(g, default=0) < len(words)}


def test_features_are_the_grams_and_skip_grams():
    texts = ["", None, "one", "One two, three. FOUR", "a a a a a", "été 12 x\ny", "x y"]
    buckets, offsets = toxicity.features(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(grams(t)) for t in texts]
    one, two = (set(toxicity.features(pa.array([t]))[0].tolist()) for t in ("big old house", "big new house"))
    assert len(one & two) == len(grams("big old house") & grams("big new house")) == 3


def test_the_learner_is_ftrl_proximal():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 12, 5)) for _ in range(200)]
    y = [int(2 in x) for x in rows]
    learner = toxicity.Learner(12, alpha=0.5, beta=1.0, l1=0.7, l2=0.3)
    z, n = [0.0] * 13, [0.0] * 13
    for x, label in zip(rows, y):
        learner.learn(x, label)
        at = [*x.tolist(), 12]
        w = {i: 0.0 if abs(z[i]) <= 0.7 else -(z[i] - np.sign(z[i]) * 0.7) / ((1 + n[i] ** 0.5) / 0.5 + 0.3) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            rate = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i], n[i] = z[i] + g - rate * w[i], n[i] + g * g
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
    w = learner.weights()
    assert w[2] == w[:-1].max() > 0 and (np.abs(learner.z) <= 0.7).sum() == (w == 0).sum()


def toxic_rows(n=1500):
    r = random.Random(6)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "rotten", "filth"]
    rows = []
    for i in range(n):
        y = int(r.random() < 0.25)
        text = [r.choice(words) for _ in range(r.randrange(20, 200))]
        if y:
            text[r.randrange(len(text))] = r.choice(bad) + r.choice(["", ",", "!!"])
        rows.append((i, " ".join(text), y if r.random() > 0.03 else 1 - y, y))
    return rows


def test_toxic_rows_that_were_held_out_are_found(spark, tmp_path):
    rows = toxic_rows()
    docs = spark.createDataFrame([(d, t, 2.5, 1) for d, t, _, _ in rows] + [(9000, None, 0.0, 0), (9001, "", 0.0, 0)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(d, s) for d, _, s, _ in rows] + [(9000, None), (None, 1)], "doc_id long, toxic int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x for x in Q.op11_toxicity(spark, f"file://{tmp_path}").collect()}
    assert set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"} and len(got) == 1502
    held = [(y, got[d]["predicted"]) for d, _, _, y in rows if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and got[d]["predicted"] == int(got[d]["score"] >= 0.7) for d in got)
    assert sum(p for y, p in held if y) >= 0.95 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.01 * len(held)
    assert got[9000]["score"] == got[9001]["score"] < 0.5


def test_labels_of_one_class_and_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    ones = [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()]
    none = [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0), F.lit(True))).collect()]
    assert min(ones) > 0.99 and none == [0.5, 0.5]
