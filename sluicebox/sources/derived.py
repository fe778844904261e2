"""Review data derived from the driver's tables (the rules are in FIXTURES.md, part C)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CHECK
from . import history

#: The tool whose trailers the derived log has.
TOOL = "Review"
#: Rows of a table that a task groups, about.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key, in partitions of about TASK_ROWS rows: what a task sorts and groups does not grow with the table."""
    return df.repartition(max(1, ceil(df.count() / TASK_ROWS)), key)


def iso(c: str):
    t = F.col(c).cast("string")
    return F.concat(F.substring(t, 1, 10), F.lit("T"), F.substring(t, 12, 8), F.lit("Z"))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a git log: one record for each event."""
    id_ = F.col("event_id")
    hash_ = F.md5(id_.cast("string").cast("binary"))
    author = F.concat(F.lit("dev"), (F.col("user_id") % 10).cast("string"))
    metrics = F.concat(F.lit(" (iter:"), (id_ % 5).cast("string"), F.lit(", coverage:"), (id_ % 101).cast("string"), F.lit("%)"))
    line = lambda x: F.concat(F.lit(f"{TOOL} {CHECK} "), x)
    kind = F.col("event_type")
    trailer = F.when(kind == "view", line(F.concat(F.lit("ran"), metrics))).when(kind == "click", line(F.concat(F.lit("vouched"), metrics))).when(kind == "signup", line(F.lit("skipped"))).when(kind == "error", line(F.lit("skipped manually"))).otherwise(F.lit(""))
    body = F.concat(kind, F.lit("\n\n"), trailer)
    fields = [F.concat(F.lit("\n"), hash_), F.substring(hash_, 1, 7), author, F.concat(author, F.lit("@example.com")), iso("ts"), kind, body]
    return table(spark, sf_dir, "events").select(F.concat_ws(history.FIELD, *fields).alias("value"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.parse(raw_log(spark, sf_dir), TOOL)


def generated_log(spark: SparkSession, n: int) -> DataFrame:
    """review_log of n made-up commits, for measuring: authors, actions and metrics in turn, one commit an hour."""
    i = F.col("id")
    hash_ = F.lower(F.lpad(F.hex("id"), 40, "0"))
    author = F.concat(F.lit("dev"), (i % 10).cast("string"))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + i * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    action = F.element_at(F.array(*map(F.lit, ("reviewed", "vouched", "skipped", "none"))), (i % 4 + 1).cast("int"))
    fields = [hash_.alias("hash"), F.substring(hash_, 34, 7).alias("short_hash"), author.alias("author"), F.concat(author, F.lit("@example.com")).alias("email"), when.alias("date"), F.lit("main").alias("branch"), F.concat(F.lit("commit "), i.cast("string")).alias("subject"), action.alias("action"), (i % 5).alias("iterations"), (i % 101).alias("coverage")]
    return spark.range(n).select(*fields)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_sessions with one session for each order; hunks come from its line items."""
    hunk = F.struct(F.lit(0).alias("old_start_line"), F.lit(0).alias("old_line_count"), (F.col("l_linenumber") * 10).alias("new_start_line"), (F.floor("l_quantity").cast("int") % 10).alias("new_line_count"))
    files = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file_path"), hunk.alias("hunk"))
    files = files.groupBy("l_orderkey", "file_path").agg(F.array_sort(F.collect_list("hunk")).alias("hunks"))
    files = files.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("file_path", "hunks"))).alias("files"))
    o = orders_as_sessions(spark, sf_dir)
    return o.join(files, o["id"] == files["l_orderkey"], "left").select("id", "tree_hash", "branch", "action", "timestamp", F.coalesce(F.to_json("files"), F.lit("[]")).alias("diff_files"), "review_id")


def orders_as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "skipped").otherwise("vouched")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("tree_hash"),
        F.concat(F.lit("b"), (F.col("o_custkey") % 20).cast("string")).alias("branch"),
        action.alias("action"),
        iso("o_orderdate").alias("timestamp"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("review_id"),
        F.col("o_custkey").alias("custkey"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments in document order (ord): one for each line item."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = li.join(part, li["l_partkey"] == part["p_partkey"])
    severity = F.when(F.col("l_returnflag") == "R", "CRITICAL").when(F.col("l_returnflag") == "A", "warning").otherwise("ERROR")
    confidence = F.when(F.col("l_linestatus") == "O", " High ").otherwise("low")
    return joined.select(
        F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file_path"),
        F.col("l_linenumber").alias("line"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        F.col("p_type").alias("type"),
        F.col("p_brand").alias("category"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Size"), (F.col("p_size") % 5).cast("string"))).alias("subcategory"),
        F.concat(F.lit("item "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("content"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"),
    )
