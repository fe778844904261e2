"""Queries over the commit graph and over pages that name the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits, paging
from ..sources import derived
from .history import LOG

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The graph as SQL: eight lines of work, each fifth commit merges another line; names for two of its commits.
_GRAPH = """
    edges AS (
        SELECT md5(CAST(event_id AS VARCHAR)) AS hash, md5(CAST(event_id - 8 AS VARCHAR)) AS parent FROM events WHERE event_id >= 8
        UNION ALL SELECT md5(CAST(event_id AS VARCHAR)), md5(CAST(event_id - 3 AS VARCHAR)) FROM events WHERE event_id >= 8 AND event_id % 5 = 0),
    refs AS (SELECT md5(CAST(max(event_id) AS VARCHAR)) AS head, md5(CAST(max(CASE WHEN event_id % 8 = 3 AND event_id < (SELECT max(event_id) FROM events) * 0.6 THEN event_id END) AS VARCHAR)) AS topic FROM events),
    of_head AS (SELECT head AS hash FROM refs UNION SELECT parent FROM of_head JOIN edges ON edges.hash = of_head.hash),
    of_topic AS (SELECT topic AS hash FROM refs UNION SELECT parent FROM of_topic JOIN edges ON edges.hash = of_topic.hash)"""


def graph(spark: SparkSession, sf_dir: str) -> commits.Graph:
    events = derived.table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    name = lambda c: F.md5(c.cast("string").cast("binary"))
    second = F.when(id_ % 5 == 0, name(id_ - 3))
    rows = events.select(name(id_).alias("hash"), F.when(id_ >= 8, F.array_compact(F.array(name(id_ - 8), second))).otherwise(F.array().cast("array<string>")).alias("parents"))
    last = events.agg(F.max("event_id").alias("last"))
    topic = events.join(last).where((id_ % 8 == 3) & (id_ < F.col("last") * 0.6)).agg(name(F.max("event_id")).alias("hash"))
    refs = last.select(F.lit("HEAD").alias("name"), name(F.col("last")).alias("hash")).unionByName(topic.select(F.lit("topic").alias("name"), "hash"))
    return commits.Graph(rows, refs)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {_GRAPH}, {LOG} {sql}"
        return f

    return register


@query("SELECT hash, author, action FROM review_log WHERE hash IN (SELECT hash FROM of_head) AND hash NOT IN (SELECT hash FROM of_topic)")
def commit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits.in_range(derived.review_log(spark, sf_dir), graph(spark, sf_dir), "topic..HEAD").select("hash", "author", "action")


@query("SELECT author, count(*) AS n FROM review_log WHERE (hash IN (SELECT hash FROM of_head)) <> (hash IN (SELECT hash FROM of_topic)) GROUP BY author")
def commit_range_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits.in_range(derived.review_log(spark, sf_dir), graph(spark, sf_dir), "topic...HEAD")
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five listings of pages; the third lacks a page, the fifth goes round."""
    events = derived.table(spark, sf_dir, "events")
    id_, name = F.col("event_id"), lambda c: F.concat(F.lit("e"), c.cast("string"))
    last = F.broadcast(events.agg(F.max("event_id").alias("last")))  # one row
    following = F.when(id_ + 5 <= F.col("last"), name(id_ + 5)).when(id_ % 5 == 4, F.lit("e4"))
    rows = events.join(last).select((id_ % 5).alias("listing"), F.when((id_ >= 5) | (id_ == 4), name(id_)).alias("start"), following.alias("next"), id_.alias("page"))
    return rows.where("page <> 502")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.ordered(listing_pages(spark, sf_dir)).select("listing", "page", "place", "status")


QUERIES["paged_listing"] = paged_listing
ORACLES["paged_listing"] = """SELECT event_id % 5 AS listing, event_id AS page, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 2 AND event_id > 502 THEN (event_id - 507) // 5 ELSE event_id // 5 END AS place,
    CASE WHEN event_id % 5 = 4 THEN 'cycle' WHEN event_id % 5 = 2 AND event_id > 502 THEN 'gap' ELSE 'ok' END AS status FROM events WHERE event_id <> 502"""
