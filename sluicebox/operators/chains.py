"""Places along linked lists, by contraction.

Each node names the one before it, and no two name the same.  A round takes out
the nodes whose hash is less than those of both neighbours, about a third of
all: the node behind takes over the pointer, and the distance to it is noted.  A
node knows its neighbour's hash from the neighbour's number, so a round is one
join of what is left.  The first node and the last one of a list stay; those taken out get their
places back in reverse order.  So all rounds together handle a few times
the rows, where pointer doubling handles all rows log2(n) times.  What is left
below SMALL rows is finished by doubling, as its rounds are short ones.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Nodes left that are finished by pointer doubling.
SMALL = 200_000


def ranked(nodes: DataFrame) -> DataFrame:
    """id, head (the first node of its list) and place (distance from it) of nodes (id long, before long or null: the first).

    Nodes of lists that go round have neither head nor place.
    """
    left = written(nodes.select("id", F.col("before").alias("to"), F.lit(1).cast("long").alias("w")))
    n, taken = left.count(), []
    while n > SMALL:
        rows = _contracted(left, len(taken))
        left = rows.where("via IS NULL").drop("via")
        before, n = n, left.count()
        taken.append(rows.where("via IS NOT NULL"))
        if n > 0.95 * before:  # short lists: doubling has few rounds
            break
    placed = _doubled(left, n)
    for out in reversed(taken):
        known = placed.select(F.col("id").alias("via"), "head", "place")
        placed = written(placed.unionByName(out.join(known, "via").select("id", "head", (F.col("place") - F.col("w")).alias("place"))))
    return placed


def _contracted(left: DataFrame, salt: int) -> DataFrame:
    """The rows left (id, to, w: the distance to it) and those taken out (via is the node behind, w the distance from there)."""
    low = F.xxhash64("id", F.lit(salt)) < F.xxhash64("to", F.lit(salt))
    inner = left.where("to <> id")
    lower = inner.where(low)
    behind = inner.where(~low).select(F.col("id").alias("via"), F.col("to").alias("at"), F.col("w").alias("step"))
    met = lower.join(behind, lower["id"] == behind["at"], "full")
    both, alone = F.col("id").isNotNull() & F.col("via").isNotNull(), F.col("id").isNull()
    row = lambda id_, to, w, via: F.struct(id_.alias("id"), to.cast("long").alias("to"), w.alias("w"), via.cast("long").alias("via"))
    w = F.coalesce("step", F.lit(0)) + F.coalesce("w", F.lit(0))
    stays = row(F.coalesce("via", "id"), F.when(alone, F.col("at")).otherwise(F.col("to")), w, F.lit(None))
    goes = F.when(both, row(F.col("id"), F.lit(None), F.col("step"), F.col("via")))
    made = met.select(F.inline(F.array_compact(F.array(stays, goes))))
    ends = left.where("to IS NULL OR to = id").withColumn("via", F.lit(None).cast("long"))
    return written(made.unionByName(ends))


def _doubled(left: DataFrame, n: int) -> DataFrame:
    """id, head and place by pointer doubling."""
    at = written(left.select("id", "to", F.when(F.col("to").isNull(), 0).otherwise(F.col("w")).cast("long").alias("place"), F.when(F.col("to").isNull(), F.col("id")).alias("head")))
    for _ in range(ceil(log2(max(2, n))) + 1):
        if at.where("to <> id").isEmpty():
            break
        further = at.select(F.col("id").alias("to"), F.col("to").alias("up"), F.col("place").alias("more"), F.col("head").alias("top"))
        at = written(at.join(further, "to", "left").select("id", F.col("up").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("head", "top").alias("head")))
    return at.select("id", "head", F.when(F.col("head").isNotNull(), F.col("place")).alias("place"))
