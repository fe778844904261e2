"""Near duplicates by the Jaccard similarity of shingle sets.

First candidates are the links of the SimHash index (``simhash.links``): the sets'
fingerprints within two bits.  Those that have the similarity unite their sets.
The other candidates, which lie farther apart, come from minwise hashes, in BANDS bands of BAND_ROWS each: two sets
of similarity s share a band with probability 1 - (1 - s ** BAND_ROWS) ** BANDS,
so one pair in seventeen thousand is missed at 0.8 and fewer above.  Every
candidate is verified by the exact similarity of the two sets.

All pairs of a list of up to PAIRED_LIST members are verified.  In a longer one
all members are held against one first; members that then are in one component
need no more.  What is outside the list's largest component is held against all
of other components, in blocks: its members and the others are dealt into blocks
of bounded size by their digest, each pair of blocks is one small task, which
counts common shingles of all its pairs at once by matrix products, and gives
back no more links than connect what it has found.  So every two sets that share
a list are verified or are in one component, a list of copies makes a link for
each member, no list is cut short, and no task grows with a list.

Defined results: a text shorter than a shingle is one shingle; texts without
words are equal to each other; equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import MERGE, map_batches, materialize, stage_result
from .simhash import components, majority, shingle_hashes
from .simhash import links as simhash_links

BAND_ROWS = 6
BANDS = 32
#: Lists up to this long are verified pair by pair.
PAIRED_LIST = 8
#: Members of a block, and shingles of all of them.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 1 << 17
#: Columns of the matrices whose products count common shingles.
PRODUCT_COLUMNS = 1 << 12

_RANDOM = np.random.default_rng(42)
_ODD = _RANDOM.integers(0, 1 << 63, BAND_ROWS * BANDS, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, BAND_ROWS * BANDS, np.uint64)
#: Shingles that are hashed at once, so that a very long text needs no more memory.
_RUN = 1 << 12


def shingles(text: str | None, size: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size) or [0], np.uint64))


def bands(of: np.ndarray) -> list[int]:
    """A digest of each band of minwise hashes."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(of), _RUN):
        part = of[at : at + _RUN]
        np.minimum(least, (part[:, None] * _ODD + _ADD).min(0), out=least)
    least = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least]


def _node(of: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(of.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, keep: list[str], size: int, text: str = "text") -> DataFrame:
    """The columns to keep, sb_fp (a digest of the shingle set), sb_sim (its SimHash) and sb_bands of each row."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("sb_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("sb_fp", T.LongType()), T.StructField("sb_sim", T.LongType()), T.StructField("sb_bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                sets = [shingles(t, size) for t in part.column("sb_text").to_pylist()]
                columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    return rows.transform(map_batches, run, schema)


def shingle_sets(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """fp and its shingle set, once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                sets = [shingles(t, size) for t in part.column("sb_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "members"])

    rows = docs.select(F.col(text).alias("sb_text")).transform(map_batches, run, "fp long, members array<long>")
    return rows.dropDuplicates(["fp"])


def links(prints: DataFrame, docs: DataFrame, keys: list[str], size: int, similarity: float, text: str = "text") -> DataFrame:
    """Links (a, b), a < b, that connect all sb_fp of prints whose sets have the similarity; docs has the texts and the keys."""
    nodes = prints.groupBy("sb_fp").agg(F.min(F.struct(*keys)).alias("one"), F.min("sb_sim").alias("sb_sim"), F.min("sb_bands").alias("sb_bands"))
    nodes = materialize(nodes, "nodes")
    posted = nodes.select(F.col("sb_fp").alias("fp"), F.posexplode("sb_bands").alias("m", "k")).select(F.xxhash64("m", "k").alias("key"), "fp")

    close = stage_result(lambda: _close(nodes), "close")
    # Texts are only hashed again where a set has a candidate.
    shared = _lists(posted)
    paired = close.select(F.explode(F.array("a", "b")).alias("sb_fp"))
    chosen = nodes.join(shared.select(F.col("fp").alias("sb_fp")).unionByName(paired).distinct().hint(MERGE), "sb_fp", "left_semi").select(*[F.col(f"one.{c}").alias(f"sb_one_{c}") for c in keys])
    same = [docs[c].eqNullSafe(F.col(f"sb_one_{c}")) for c in keys]
    sets = materialize(shingle_sets(docs.join(chosen.hint(MERGE), same, "left_semi"), size, text), "sets")

    near = _verified(close, sets, similarity)
    found = near.unionByName(_verified(_pairs(shared).join(close.hint(MERGE), ["a", "b"], "left_anti"), sets, similarity))
    long = shared.where(F.col("n") > PAIRED_LIST).select("key", "fp")
    if long.isEmpty():
        return found
    return found.unionByName(_across(_parted(long, found), sets, similarity))


def _close(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sb_fp that connect all whose SimHashes are within two bits: by the index of positional bytes."""
    sims = materialize(nodes.groupBy("sb_sim").agg(F.min("sb_fp").alias("first")), "sims")
    of = lambda sim, name: sims.select(F.col("sb_sim").alias(sim), F.col("first").alias(name))
    apart = simhash_links(sims.select(F.col("sb_sim").alias("fp"))).withColumnsRenamed({"a": "sa", "b": "sb"})
    apart = apart.join(of("sa", "a").hint(MERGE), "sa").join(of("sb", "b").hint(MERGE), "sb").select("a", "b")
    same = nodes.join(sims.hint(MERGE), "sb_sim").where("sb_fp > first").select(F.col("first").alias("a"), F.col("sb_fp").alias("b"))
    return apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same)


def _parted(long: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, fp, root) of lists with more than one component, and whether they are outside the largest (out)."""
    roots = components(found).select("fp", "root")
    rooted = materialize(long.join(roots.hint(MERGE), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    largest = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    some = materialize(largest.where("roots > 1").select("key", "main"), "largest")
    return rooted.join(some.hint(MERGE), "key").select("key", "fp", "root", (F.col("root") != F.col("main")).alias("out"))


def _across(parted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect members of different components, at least one outside its list's largest."""
    parted = materialize(parted.join(sets.select("fp", F.size("members").alias("size")).hint(MERGE), "fp"), "parted")
    blocks = lambda on: F.greatest(F.ceil(F.count_if(on) / BLOCK_ROWS), F.ceil(F.sum(F.when(on, F.col("size")).otherwise(0)) / BLOCK_SHINGLES))
    many = parted.groupBy("key").agg(blocks(F.col("out")).cast("int").alias("n_out"), blocks(~F.col("out")).cast("int").alias("n_main"))
    rows = parted.join(many.hint(MERGE), "key")
    of = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Blocks of the largest component have negative numbers; two of them never meet.
    outside = F.concat(F.transform(each("n_out"), lambda j: F.struct(F.least(of("n_out"), j).alias("i"), F.greatest(of("n_out"), j).alias("j"))), F.transform(each("n_main"), lambda j: F.struct(of("n_out").alias("i"), (-1 - j).alias("j"))))
    main = F.transform(each("n_out"), lambda i: F.struct(i.alias("i"), (-1 - of("n_main")).alias("j")))
    dealt = rows.select("key", "fp", "root", F.explode(F.when(F.col("out"), outside).otherwise(main)).alias("b")).select("key", "b.i", "b.j", "fp", "root")
    members = dealt.join(sets.hint(MERGE), "fp").groupBy("key", "i", "j").agg(F.collect_list(F.struct("fp", "root", "members")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                found = connecting(rows.values.field("fp").to_pylist(), rows.values.field("root").to_pylist(), [np.asarray(x.values) for x in rows.values.field("members")], similarity)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return materialize(members.select("rows").transform(map_batches, run, "a long, b long").distinct(), "across")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common (the diagonal is left open)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles of two sets or more count.
    number = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    owner, column = owner[shared], number[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, PRODUCT_COLUMNS):
        a, b = np.searchsorted(column, [first, first + PRODUCT_COLUMNS])
        has = np.zeros((len(sets), PRODUCT_COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        out += has @ has.T
    return out


def connecting(names: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of names (a, b), a < b, with the similarity, as few as connect all roots that such pairs connect."""
    both, size = common(sets).astype(np.float64), np.array([len(x) for x in sets])
    near = np.argwhere(np.triu(both >= similarity * (size[:, None] + size[None, :] - both), 1))
    up = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    for i, j in near.tolist():
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            up[a] = b
            out.append((min(names[i], names[j]), max(names[i], names[j])))
    return out


def _lists(posted: DataFrame) -> DataFrame:
    """posted (key, fp) with the number of its list's members (n, 2 or more) and the smallest of them (first)."""
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")).where("n > 1")
    return materialize(posted.join(lists.hint(MERGE), "key"), "shared")


def _pairs(shared: DataFrame) -> DataFrame:
    """All pairs (a, b) of short lists, and of each longer one those of its first member."""
    members = shared.where(F.col("n") <= PAIRED_LIST).groupBy("key").agg(F.collect_list("fp").alias("l"))
    all_pairs = F.expr("flatten(transform(l, x -> transform(filter(l, y -> y > x), y -> struct(x as a, y as b))))")
    short = members.select(F.explode(all_pairs).alias("e")).select("e.a", "e.b")
    star = shared.where((F.col("n") > PAIRED_LIST) & (F.col("fp") > F.col("first"))).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return short.unionByName(star)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity."""
    # Written first: Spark can split the pairs of a member that very many are held against.
    pairs = materialize(pairs.distinct(), "pairs")
    a, b = (sets.select(F.col("fp").alias(c), F.col("members").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(a.hint(MERGE), "a").join(b.hint(MERGE), "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both))
    return materialize(near.select("a", "b"), "found")
