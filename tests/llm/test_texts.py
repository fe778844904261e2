"""Text operators against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import decontam, language, quality, sharding, simhash, substring
from sluicebox.llm.common import crc32_fold

WORDS = ["the", "of", "And", "é", "x1", "日本", "don't", "end.", "to", "in"]


def make(seed, n, passages, words=WORDS):
    r = random.Random(seed)
    out = []
    for i in range(n):
        parts = [" ".join(r.choice(words) + str(r.randrange(400)) for _ in range(r.randrange(0, 90)))]
        for _ in range(r.randrange(3)):
            parts.append(r.choice(passages))
            parts.append(" ".join(r.choice(words) + str(r.randrange(400)) for _ in range(r.randrange(0, 30))))
        out.append((i, r.choice([" ", "\n", "  ", "\t"]).join(parts)))
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    return [" ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(k)) for k in (12, 34, 35, 36, 60, 120)] + ["same " * 80]


def frame(spark, rows):
    # Other columns have the names that operators use inside.
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], "doc_id long, text string, fp int, kept string, n_words long")


EDGES = [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "tie tie"), (105, "tie tie"), (None, "no id " * 40), (None, "no id " * 40)]


def test_decontamination(spark, passages):
    docs = make(1, 60, passages) + [e for e in EDGES if e[0] is not None]
    items = [(1, passages[0]), (2, passages[3]), (10, "tie"), (11, None), (12, ""), (3, "End. x1 of, zz"), (2, passages[4]), (4, passages[4] + " more words"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute.decontam(docs, [i for i in items if i[0] is not None])
    for block in (1 << 24, 300):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(frame(spark, docs), bench, block_bytes=block).collect()}
        assert got == expected
    assert sum(x[4] for x in expected.values()) > 10


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.contamination(frame(spark, EDGES), none).collect()
    assert len(rows) == len(EDGES) and not any(r["contaminated"] for r in rows)
    assert decontam.contamination(frame(spark, []), none).count() == 0


def digest(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substrings(spark, passages, batches):
    docs = make(2, 50, passages) + EDGES
    assert digest(substring.remove_repeats(frame(spark, docs), batches=batches).collect()) == brute.substrings(docs)


def test_substrings_of_small_windows(spark, passages):
    docs = make(3, 25, passages)
    got = digest(substring.remove_repeats(frame(spark, docs), window=9).collect())
    assert got == brute.substrings(docs, 9)


def test_substring_edges(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    kept = substring.remove_repeats(frame(spark, EDGES), replace=True)
    assert kept.columns == frame(spark, EDGES).columns and kept.count() == len(EDGES)


def test_index_finds_later_batches_in_earlier_runs_and_compacts(spark, passages):
    index = substring.FingerprintIndex(spark, buckets=3, fan_in=3)
    a = frame(spark, [(1, passages[4] + " one")])
    b = frame(spark, [(2, "two " + passages[4])])
    c = frame(spark, [(3, "three " + passages[5])])
    assert index.ingest(a).count() == 0
    assert index.ingest(b).count() > 0
    assert index.ingest(c).count() == 0 and len(index.runs) == 1
    assert index.ingest(a).count() > 0
    index.drop()


def test_simhash(spark, passages):
    docs = make(4, 40, passages) + EDGES[:6]
    r = random.Random(9)
    for d, t in list(docs)[:30]:
        w = (t or "").split()
        if len(w) > 60:
            w[r.randrange(len(w))] = "changed"
            docs.append((d + 1000, " ".join(w)))
    prints = [(d, brute.simhash(t)) for d, t in docs]
    roots = brute.components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {d: (f"{f:016x}", roots[d]) for d, f in prints}
    assert any(roots[d] != d for d in roots)
    kept = simhash.keep_one(frame(spark, docs)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(roots.values()))


def near_prints(seed, n):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(4)]
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(n):
        x = r.choice(seeds)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(64 if r.random() < 0.3 else 16)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("paired", [2, 32])
def test_links_lose_no_component(spark, monkeypatch, paired):
    """Dense groups of fingerprints, some in lists too long to be paired."""
    monkeypatch.setattr(simhash, "PAIRED_LIST", paired)
    prints = near_prints(3, 600)
    signed = [(simhash._signed(p),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r["fp"]: r["root"] for r in simhash.components(links).collect()}
    expected = brute.components([(p, p) for p in prints])
    groups = {}
    for p in prints:
        s = simhash._signed(p)
        groups.setdefault(expected[p], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_no_table_of_documents_is_broadcast(spark, monkeypatch):
    """The driver builds what is broadcast: its memory would grow with each round of the components."""
    from sluicebox.llm import jaccard

    plans = []
    for module in (simhash, jaccard):
        monkeypatch.setattr(module, "materialize", lambda df, name, write=module.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    docs = frame(spark, [(i, f"a b c d e f g h {i % 7} {i % 3}") for i in range(60)])
    for out in (simhash.near_duplicates(docs), simhash.keep_one(docs, size=5, similarity=0.8)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r["component_id"] for r in rows if r["doc_id"] in (100, 101, 102)} == {100}
    assert len([r for r in simhash.keep_one(frame(spark, EDGES)).collect() if r["doc_id"] is None]) == 1


def shards(rows, limit):
    h = {d: int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, _ in rows}
    size = [(d, len((t or "").encode())) for d, t in rows]
    out, todo = {}, [(0, 0, size)]
    while todo:
        bits, prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit or bits == 60:
            out |= {d: (bits, prefix) for d, _ in own}
            continue
        for b in (0, 1):
            part = [x for x in own if h[x[0]] >> (59 - bits) & 1 == b]
            if part:
                todo.append((bits + 1, prefix * 2 + b, part))
    return out


@pytest.mark.parametrize("limit", [10**9, 5000, 700, 120])
def test_shards(spark, passages, limit):
    docs = make(6, 80, passages) + EDGES[:6]
    big = {d for d, t in docs if len((t or "").encode()) > limit}
    rows = sharding.assign(frame(spark, docs), limit).collect()
    expected = shards(docs, limit)
    for r in rows:
        bits, prefix = expected[r["doc_id"]]
        assert r["shard_bits"] == bits and r["shard"].split(":")[0] == (f"{prefix:0{bits}b}" if bits else "")
        assert r["shard_bytes"] <= limit or r["doc_id"] in big
    assert len(rows) == len(docs)


def test_shards_of_one_id_get_pages(spark, tmp_path):
    same = [(7, "x" * 100 + str(i)) for i in range(10)]
    rows = sharding.assign(frame(spark, same), 350).collect()
    assert len(rows) == 10 and len({r["shard"] for r in rows}) >= 3
    sharding.write_shards(frame(spark, same + EDGES).drop("n_words"), f"file://{tmp_path}/shards", 350)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == 18
    assert sharding.assign(frame(spark, [])).count() == 0


def test_overflow_pages_fit_the_limit(spark):
    r = random.Random(4)
    sizes = [101] * 10 + [60, 100, 50, 80, 401, 0, 1, 349, 350, 351, 900] + [r.randrange(400) for _ in range(150)]
    rows = [(d, "x" * n) for d in (7, None) for n in sizes]
    out = sharding.assign(frame(spark, rows), 350).collect()
    pages = defaultdict(list)
    for x in out:
        pages[x["shard"]].append(x)
    assert sorted((str(x["doc_id"]), x["n_bytes"]) for x in out) == sorted((str(d), len(t)) for d, t in rows)
    for shard in pages.values():
        total = sum(x["n_bytes"] for x in shard)
        assert {x["shard_bytes"] for x in shard} == {total} and (total <= 350 or len(shard) == 1)
    # Pages of one id are numbered from 0 and, but for the last of a kind, at least half full.
    own = sorted({int(x["shard"].split(":")[1]) for x in out if x["doc_id"] == 7})
    assert own == list(range(len(own))) and len(own) < 2 * sum(sizes) / 350 + 20


def test_language(spark):
    r = random.Random(3)
    vocab = {"en": ["the", "and", "with", "thing", "which", "house"], "de": ["und", "der", "nicht", "über", "häuser", "schön"], "ru": ["это", "дом", "который", "быть"]}
    text = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(["en", "de", "ru"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, ~crc32_fold("doc_id", 3, 1))
    mixed = text("en", 40) + " " + text("de", 60)
    extra = [(900, None, "en"), (901, "", "en"), (902, "123 ...", "en"), (903, mixed, None), (904, "это дом", None), (905, "日本語", None)]
    out = {r["doc_id"]: r for r in language.identify(docs.unionByName(spark.createDataFrame(extra, docs.schema)), model, spans=True).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in rows)
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und", "und", "und", "ru"]
    assert out[903]["lang_pred"] == "de" and {s["lang"] for s in out[903]["spans"]} == {"en", "de"} and 0.4 < out[903]["lang_score"] < 1
    assert len(out[903]["spans"]) == 2 and out[905]["lang_pred"] in vocab
    left = language.identify(docs.unionByName(spark.createDataFrame(extra, docs.schema)), model, min_score=0.5)
    assert left.columns == docs.columns and left.count() == len(rows) + 3


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    scores = r.normal(size=(11, 3)).astype(np.float32) * 3
    first = np.array([0, 0, 5, 6, 11])
    got = language.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda path: sum(float(scores[a + i, s]) for i, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert abs(value(got[a:b]) - best) < 1e-4


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = language.identify(docs, language.train(docs, F.lit(True))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert language.identify(docs.limit(0), language.train(docs, F.lit(True))).count() == 0


def test_quality_on_held_out_rows(spark):
    r = random.Random(8)
    good = lambda: " ".join(r.choice(["calm", "river", "stone", "bright", "winter"]) + str(r.randrange(50)) for _ in range(30)) + "."
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "CLICK"]) + "!!" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)] + [(7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, ~crc32_fold("doc_id", 4, 2))
    out = {x["doc_id"]: x for x in quality.score(docs.withColumn("held_out", crc32_fold("doc_id", 4, 2)), model).collect()}
    held = [i for i in range(240) if out[i]["held_out"]]
    assert len(held) > 30 and all(out[i]["predicted"] == bool(i % 3) for i in held)
    assert out[500]["score"] == out[501]["score"] and all(0 <= x["score"] <= 1 for x in out.values())
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert {x["predicted"] for x in quality.score(docs, one).collect()} == {1}
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {x["score"] for x in quality.score(docs, none).collect()} == {0.5}


def test_descent_separates():
    import numpy as np

    w, b = quality.descend([np.array([0]), np.array([1]), np.array([0, 2])], [np.array([1.0]), np.array([1.0]), np.array([0.7, 0.7])], np.array([1, -1, 1]), 3)
    assert w[0] + b > 0 > w[1] + b
