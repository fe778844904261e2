"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash.  Starting from one
bucket, only buckets over the byte limit split, each on its next bit, until all
fit.  Row sizes are summed by hash prefix before anything else, so a round works
on a few sums per bucket, never on rows; rows meet the finished directory in one
join.  A bucket whose rows share all hash bits (rows of one id) cannot be split by bits;
it gets overflow pages instead, each of rows of like size so that none passes the limit.

Defined results: null and empty texts have size 0; a single row over the limit
is a page of its own; repeated rows are placed each for itself; an empty table
has no shards; other columns are never looked at, and kept where assign() is told to carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hash bits that exist; a bucket at this depth is split into overflow pages.
HASH_BITS = 60
#: Bits that one round of splitting looks at.
ROUND_BITS = 10
MAX_SHARD_BYTES = 8 << 20
#: Up to so many rows a page, overflow pages are told apart by every number of rows.
PAGE_ROWS = 16
#: Overflow pages that are filled by one task, about.
PART_PAGES = 64


def hash_of(key: str) -> Column:
    """The first 60 bits of the md5 of a key as text (a null key counts as the text "null")."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(hash_: str | Column, bits: Column | int) -> Column:
    return F.expr(f"shiftright({hash_}, {HASH_BITS} - {bits})")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """bits, prefix and bytes of each bucket; sized has sb_hash and sb_bytes."""
    open_, leaves, depth = sized, [], 0
    while True:
        deep = min(HASH_BITS, depth + ROUND_BITS)
        # One sum for each prefix of this round's last bit; a bucket of a higher level is the sum of its own.
        cells = open_.groupBy(_prefix("sb_hash", deep).alias("cell")).agg(F.sum("sb_bytes").alias("bytes"))
        first = depth if depth == 0 else depth + 1
        nodes = cells.select(F.explode(F.sequence(F.lit(first), F.lit(deep))).alias("bits"), "cell", "bytes")
        nodes = nodes.groupBy("bits", F.expr(f"shiftright(cell, {deep} - bits)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        nodes = materialize(nodes, "nodes")
        # A bucket ends here if it fits and the bucket it was split from did not.
        over = nodes.where(F.col("bytes") > limit).select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
        fits = nodes.where((F.col("bytes") <= limit) | (F.lit(deep) == HASH_BITS) & (F.col("bits") == HASH_BITS))
        split = fits.where(F.col("bits") > first).withColumn("parent", F.shiftright("prefix", 1)).join(over, ["bits", "parent"]).select("bits", "prefix", "bytes")
        # All buckets of a round's first level come from oversized ones.
        leaves.append(fits.where(F.col("bits") == first).select("bits", "prefix", "bytes").unionByName(split))
        large = nodes.where((F.col("bits") == deep) & (F.col("bytes") > limit)).select("prefix")
        if deep == HASH_BITS or large.isEmpty():
            break
        open_ = open_.join(large, _prefix("sb_hash", deep) == F.col("prefix"), "left_semi")
        depth = deep
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def pages(rows: DataFrame, limit: int) -> DataFrame:
    """rows of buckets over the limit with page (from 0 in each bucket) and shard_bytes; a page fits the limit or is one row.

    Rows of like size share pages: n rows a page, of limit / n bytes at most each.
    A large bucket is dealt out by its rows' content first, so that no task gets all of it.
    """
    size = F.greatest("sb_bytes", F.lit(1))
    rows = rows.withColumn("sb_n", F.greatest(F.floor(F.lit(limit) / size), F.lit(1)).cast("long"))
    # From PAGE_ROWS on powers of two, so that there are few kinds of pages.
    rows = rows.withColumn("sb_n", F.when(F.col("sb_n") <= PAGE_ROWS, F.col("sb_n")).otherwise(F.expr("shiftleft(1L, length(bin(sb_n)) - 1)")))
    rows = rows.withColumn("sb_part", F.pmod(F.xxhash64("sb_digest"), F.floor(F.col("bytes") / F.lit(PART_PAGES * limit)) + 1))
    group = ["prefix", "sb_part", "sb_n"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy("sb_digest", "sb_key")) - 1
    rows = materialize(rows.withColumn("sb_page", F.floor(place / F.col("sb_n")).cast("long")), "pages")
    filled = rows.groupBy(*group, "sb_page").agg(F.sum("sb_bytes").alias("shard_bytes"))
    # Pages are numbered through a bucket: a few sums for each.
    before = Window.partitionBy("prefix").orderBy("sb_part", "sb_n").rowsBetween(Window.unboundedPreceding, -1)
    counts = filled.groupBy(*group).agg(F.count(F.lit(1)).alias("sb_pages")).withColumn("sb_before", F.coalesce(F.sum("sb_pages").over(before), F.lit(0))).drop("sb_pages")
    filled = filled.join(counts, group)
    return rows.join(filled, [*group, "sb_page"]).withColumn("page", F.col("sb_before") + F.col("sb_page"))


def assign(docs: DataFrame, limit: int = MAX_SHARD_BYTES, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns to carry), n_bytes, shard (bucket bits, colon, page), shard_bits and shard_bytes of each row.

    Columns to carry that have an output's name are replaced by the output.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    carry = [c for c in carry or [] if c not in (key, "n_bytes", "shard", "shard_bits", "shard_bytes")]
    rows = materialize(docs.select(*carry, F.col(key).alias("sb_key"), hash_of(key).alias("sb_hash"), size.alias("sb_bytes"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("sb_digest")), "rows")
    buckets = materialize(directory(rows, limit), "directory")
    depths = [r["bits"] for r in buckets.select("bits").distinct().collect()]  # 61 at most
    # A row's bucket is the only one of all depths whose prefix it has.
    if not depths:
        depths = [0]
    probes = F.array(*[F.struct(F.lit(d).alias("bits"), _prefix("sb_hash", d).alias("prefix")) for d in sorted(depths)])
    hit = rows.select("*", F.explode(probes).alias("at")).select(*carry, "sb_key", "sb_hash", "sb_bytes", "sb_digest", "at.bits", "at.prefix").join(buckets, ["bits", "prefix"])
    plain = hit.where(F.col("bytes") <= limit).select("*", F.lit(0).cast("long").alias("page"), F.col("bytes").alias("shard_bytes"))
    paged = pages(hit.where(F.col("bytes") > limit), limit)
    placed = plain.unionByName(paged.select(*plain.columns))
    shard = F.concat(F.when(F.col("bits") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("bits"), F.lit("0"))), F.lit(":"), F.col("page"))
    return placed.select(*carry, F.col("sb_key").alias(key), F.col("sb_bytes").alias("n_bytes"), shard.alias("shard"), F.col("bits").cast("int").alias("shard_bits"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = MAX_SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write docs to path with a folder for each shard (shard=<bits>:<page>)."""
    numbered = materialize(docs.withColumn("sb_row", F.monotonically_increasing_id()), "numbered")
    placed = assign(numbered, limit, key, text, carry=["sb_row"]).select("sb_row", "shard")
    numbered.join(placed, "sb_row").drop("sb_row").repartition("shard").write.partitionBy("shard").parquet(path)
