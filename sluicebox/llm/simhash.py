"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes.  Two fingerprints that
differ in two bits or fewer differ in two bytes at most, so they share six
positional bytes or more: the guaranteed minimum.  Lists of a single byte and its
place would hold a 256th of the corpus, so the index is posted by groups of
GROUP_BYTES positional bytes (56 postings for each distinct fingerprint), and
the tally of a pair is the number of lists that it shares: six shared bytes give
six shared groups at least.  Pairs that reach this are verified by their Hamming
distance.

A list of more than PAIRED_LIST members makes no pairs.  Its members differ in
the three open bytes alone: each is posted again under itself and each of the 24
fingerprints one bit away there.  Two members within two bits meet at the
fingerprint midway, the 25 at most that meet there are within two bits of each
other, and one link from each to the smallest keeps them together.  A pair that
shares a long list is linked so; a pair that shares none has its whole tally.

Documents of one fingerprint are one node.  Components are found by spreading
the smallest label along links with pointer jumping.

Defined results: a text without words has fingerprint zero and links like any
other; repeated rows share a fingerprint; a null doc_id never names a component
unless no other id is in it; an empty table gives an empty table; other columns
are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V
from .common import MERGE, map_batches, materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Positional bytes that a posting stands for.
GROUP_BYTES = 5
#: Groups that a pair shares at least if it shares all bytes but MAX_DISTANCE.
MIN_TALLY = comb(8 - MAX_DISTANCE, GROUP_BYTES)
#: Lists up to this long are tallied pair by pair.
PAIRED_LIST = 32

_LOWER = bytes(V.lower_table())


def _signed(x: int) -> int:
    """The 64 bits of x as a signed integer."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """The 64-bit hash of each shingle of lower-cased words; a shorter text is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    return majority(shingle_hashes(text, size))


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer; zero if there is none."""
    if not len(hashes):
        return 0
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", out: str = "sb_fp", size: int = SHINGLE_WORDS) -> DataFrame:
    """The columns to keep and the fingerprint (signed) of each row."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("sb_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, "sb_text"):
                prints = [fingerprint(t, size) for t in part.column("sb_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints, pa.int64())], names=schema.names)

    return rows.transform(map_batches, run, schema)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints (column fp) within MAX_DISTANCE."""
    groups = list(combinations(range(8), GROUP_BYTES))
    masks = [_signed(sum(0xFF << 8 * i for i in g)) for g in groups]
    postings = F.array(*[F.struct(F.lit(m).cast("byte").alias("m"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("k")) for m, mask in enumerate(masks)])
    posted = distinct.select("fp", F.explode(postings).alias("p")).select("fp", "p.m", "p.k")
    sizes = posted.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = materialize(posted.join(sizes.hint(MERGE), ["m", "k"]), "listed")
    # Only short lists are gathered; the members of long ones stay rows.
    members = listed.where(F.col("n") <= PAIRED_LIST).groupBy("m", "k").agg(F.collect_list("fp").alias("members"))
    pairs = F.expr("flatten(transform(members, x -> transform(filter(members, y -> y > x), y -> struct(x as a, y as b))))")
    shared = members.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    tallied = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tally")).where(F.col("tally") >= MIN_TALLY)
    short = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).select("a", "b")
    long = listed.where(F.col("n") > PAIRED_LIST).select("m", "fp")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << 8 * p + b)).cast("long") for p in set(range(8)) - set(g) for b in range(8)]) for g in groups])
    midway = long.select("m", "fp", F.explode(flips[F.col("m").cast("int")]).alias("flip")).select("m", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = midway.groupBy("m", "at").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    met = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return short.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint that has a link: root is the smallest in its component."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("fp"), F.least("a", "b").alias("root"))
    label = materialize(label, "labels")
    while True:
        spread = both.join(label.hint(MERGE), both["b"] == label["fp"]).select(both["a"].alias("fp"), "root").groupBy("fp").agg(F.min("root").alias("seen"))
        lower = label.join(spread.hint(MERGE), "fp", "left").select("fp", F.least("root", F.coalesce("seen", "root")).alias("root"), F.col("root").alias("was"))
        lower = materialize(lower, "lower")
        jump = lower.select(F.col("fp").alias("at"), F.col("root").alias("up"))
        # The label's own label is as good and may be lower.
        jumped = lower.join(jump.hint(MERGE), lower["root"] == jump["at"], "left").select("fp", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("was")).alias("moved"))
        jumped = materialize(jumped, "jumped")
        label = jumped.select("fp", "root")
        if jumped.where("moved").isEmpty():
            return label


def classes(prints: DataFrame, key: str, edges: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) for each distinct sb_fp of prints; the id is the smallest key in the component."""
    known = materialize(prints.groupBy(F.col("sb_fp").alias("fp")).agg(F.min(key).alias("least")), "classes")
    roots = components(links(known.select("fp")) if edges is None else edges)
    rooted = known.join(roots.hint(MERGE), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(smallest.hint(MERGE), "root").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of each row."""
    prints = materialize(fingerprints(docs, [key], text), "prints")
    of = classes(prints, key)
    joined = prints.join(of.hint(MERGE), prints["sb_fp"] == of["fp"])
    return joined.select(key, F.lower(F.lpad(F.hex("sb_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: the one of the smallest id (of equal ids, the smallest text digest).

    Links are fingerprints within MAX_DISTANCE; with a similarity, these are
    verified by the Jaccard similarity of the shingle sets, and sets that have it
    with fingerprints farther apart are linked, too.
    """
    # The user's columns stand in one, so that none has the name of one of ours.
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("sb_row"), F.col(key).alias("sb_id"), F.col(text).alias("sb_text"))
    rows, keys = whole.withColumn("sb_digest", F.xxhash64(F.coalesce("sb_text", F.lit("")))), ["sb_id", "sb_digest"]
    if similarity is None:
        prints, edges = materialize(fingerprints(rows, keys, "sb_text", size=size), "prints"), None
    else:
        from . import jaccard

        prints = materialize(jaccard.signatures(rows, keys, size, "sb_text"), "prints")
        edges = jaccard.links(prints, rows, keys, size, similarity, "sb_text")
    of = classes(prints, "sb_id", edges)
    joined = prints.join(of.hint(MERGE), prints["sb_fp"] == of["fp"])
    chosen = joined.groupBy("component_id", "fp").agg(F.min(F.struct(F.col("sb_id").isNull().alias("n"), F.col("sb_id").alias("k"), F.col("sb_digest").alias("d"))).alias("first"))
    chosen = chosen.groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.k").alias("sb_key"), F.col("first.d").alias("sb_kept"))
    kept = rows.join(chosen.hint(MERGE), rows["sb_id"].eqNullSafe(F.col("sb_key")) & (rows["sb_digest"] == F.col("sb_kept")))
    # Repeated rows of the chosen id and text: tasks drop theirs before the shuffle.
    return kept.dropDuplicates(keys).select("sb_row.*")
