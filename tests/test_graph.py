"""Ranges of the commit graph against a plain walk."""

import random

import pytest

from sluicebox.operators import chains, commits, paging


def walk(parents, tip):
    seen, todo = set(), [tip]
    while todo:
        if (at := todo.pop()) not in seen:
            seen.add(at)
            todo += parents.get(at, [])
    return seen


def frame(spark, parents, refs=()):
    rows = spark.createDataFrame(list(parents.items()), "hash string, parents array<string>").repartition(3)
    return commits.Graph(rows, spark.createDataFrame(list(refs), "name string, hash string"))


def hashes(df):
    rows = [r["hash"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,n", [(2, 120)])
def test_ranges_of_random_graphs(spark, seed, n):
    r = random.Random(seed)
    parents = {f"c{i:04}": [f"c{j:04}" for j in dict.fromkeys(r.randrange(max(0, i - 12), i) for _ in range(r.choice([1, 1, 1, 2, 2, 3])))] if i % 17 else [] for i in range(n)}
    graph = frame(spark, parents, [("HEAD", f"c{n - 1:04}"), ("old", f"c{n // 2:04}")])
    a, b = walk(parents, f"c{n // 2:04}"), walk(parents, f"c{n - 1:04}")
    assert hashes(graph.within("old..HEAD")) == b - a
    assert hashes(graph.within("old...HEAD")) == a ^ b
    assert hashes(graph.within("old")) == a


def test_a_deep_chain_takes_one_round(spark):
    parents = {f"{i:040d}": [f"{i - 1:040d}"] if i else [] for i in range(3000)}
    graph = frame(spark, parents, [("HEAD", f"{2999:040d}")])
    assert len(graph.jumps()) == 12
    assert len(hashes(graph.within("HEAD~2000..HEAD"))) == 2000 and graph.rounds == 1
    assert graph.resolve("HEAD~2999") == f"{0:040d}"
    with pytest.raises(commits.RangeError):
        graph.resolve("HEAD~3000")


def test_revisions(spark):
    graph = frame(spark, {"aaaa1": ["bbbb1", "cccc1"], "bbbb1": ["dddd1"], "cccc1": ["dddd1"], "dddd1": ["gone"], "aaaa2": []}, [("HEAD", "aaaa1"), ("twice", "bbbb1"), ("twice", "cccc1")])
    assert [graph.resolve(x) for x in ("HEAD", "HEAD^", "HEAD^2", "HEAD^2~", "HEAD~2", "HEAD^0", "bbbb", "HEAD^^")] == ["aaaa1", "bbbb1", "cccc1", "dddd1", "dddd1", "aaaa1", "bbbb1", "dddd1"]
    for bad in ("aaaa", "twice", "nobody", "--output=/tmp/x", "", "bb", "HEAD^3", "HEAD~9"):
        with pytest.raises(commits.RangeError):
            graph.resolve(bad)
    # A parent that the table lacks is reached, but no row of a log.
    log = spark.createDataFrame([("aaaa1",), ("dddd1",), ("aaaa2",)], "hash string")
    assert hashes(commits.in_range(log, graph, "HEAD")) == {"aaaa1", "dddd1"}


def test_pages_come_in_order_with_gaps_and_cycles(spark):
    made = lambda name, starts, last=None: [(name, a, b, f"{name}{i}") for i, (a, b) in enumerate(zip(starts, [*starts[1:], last]))]
    rows = made("long", [None, *(f"n{i:03}" for i in range(1, 300))]) + made("one", [None])
    gap = made("gap", [None, *(f"g{i}" for i in range(1, 9))])
    rows += [*gap[:4], *gap[5:], gap[2], *made("round", ["a", "b", "c"], "a")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "listing string, start string, next string, page string").repartition(3)
    got = {r["page"]: (r["place"], r["status"]) for r in paging.ordered(df).collect()}
    assert {p: x for p, x in got.items() if p.startswith("long")} == {f"long{i}": (i, "ok") for i in range(300)} and got["one0"] == (0, "ok")
    assert [got.get(f"gap{i}") for i in range(9)] == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok"), None, (0, "gap"), (1, "gap"), (2, "gap"), (3, "gap")]
    assert [got[f"round{i}"] for i in range(3)] == [(None, "cycle")] * 3
    assert paging.ordered(df.limit(0)).count() == 0


def test_places_come_by_contraction(spark, monkeypatch):
    monkeypatch.setattr(chains, "SMALL", 20)
    rounds, doubled = [], []
    monkeypatch.setattr(chains, "_contracted", lambda left, salt, f=chains._contracted: rounds.append(salt) or f(left, salt))
    monkeypatch.setattr(chains, "_doubled", lambda left, n, f=chains._doubled: doubled.append(n) or f(left, n))
    numbers = random.Random(4).sample(range(10**6), 500)
    lists = [numbers[:300], numbers[300:301], numbers[301:400]]
    nodes = [(b, a) for x in lists for a, b in zip([None, *x], x)] + list(zip(numbers[400:], [*numbers[401:], numbers[400]]))
    got = {r["id"]: (r["head"], r["place"]) for r in chains.ranked(spark.createDataFrame(nodes, "id long, before long").repartition(3)).collect()}
    expected = {b: (x[0], i) for x in lists for i, b in enumerate(x)} | {b: (None, None) for b in numbers[400:]}
    assert got == expected and len(rounds) > 3 and doubled[0] < 60


def test_a_range_is_one_place_a_path(spark):
    """A merge in each fifth commit, four lines of work, a commit listed twice and a branch that names the same parent."""
    parents = {f"c{i:04}": ([f"c{i - 4:04}"] + [f"c{i - 3:04}"] * (i % 5 == 0)) if i >= 4 else [] for i in range(400)} | {"d1": ["c0200", "c0200"], "d2": ["c0200", "c0199"]}
    graph = frame(spark, parents, [("HEAD", "c0399"), ("old", "d2"), ("gone", "nowhere")])
    graph.commits = graph.commits.unionByName(graph.commits.where("hash = 'c0200'"))
    a, b = walk(parents, "d2"), walk(parents, "c0399")
    assert hashes(graph.within("old..HEAD")) == b - a and hashes(graph.within("old...HEAD")) == a ^ b
    assert graph.reached({"a": "d2", "b": "c0399"}).count() < 20 and graph.rounds < 8
    assert hashes(graph.within("gone")) == {"nowhere"} and hashes(graph.within("gone..old")) == a
