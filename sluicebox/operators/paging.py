"""Pages of listings put in order by the cursors that they name.

A page begins at a name (null for the first of its listing) and names where the
next one begins.  Each page knows the page before it, and ``chains`` gives the places
of all pages at once, without a walk from page to page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .chains import ranked


def ordered(pages: DataFrame) -> DataFrame:
    """pages (listing, start, next and others) with place and status.

    Place counts from 0.  Status is ok, or gap for pages after one that is
    missing (their place counts from the first page behind it), or cycle for
    pages whose cursors go round, which have no place.  Of pages that were
    fetched twice (same listing and start) one counts; two pages that name the
    same next one are one chain from there on, and the longer way counts.
    """
    # A page is named by its start, the first one by the empty name; its number is odd then.
    number = F.monotonically_increasing_id() * 2 + F.col("start").isNull().cast("int")
    once = written(pages.dropDuplicates(["listing", "start"]).withColumn("paging_id", number))
    naming = once.where("next IS NOT NULL").groupBy("listing", F.col("next").alias("start")).agg(F.max(F.struct(F.coalesce("start", F.lit("")).alias("s"), "paging_id"))["paging_id"].alias("before"))
    nodes = once.select("listing", "start", F.col("paging_id").alias("id")).join(naming, ["listing", "start"], "left")
    placed = ranked(nodes.select("id", "before")).withColumnRenamed("id", "paging_id")
    status = F.when(F.col("head").isNull(), "cycle").when(F.col("head") % 2 == 1, "ok").otherwise("gap")
    return once.join(placed, "paging_id").select("listing", *[c for c in pages.columns if c != "listing"], "place", status.alias("status"))
