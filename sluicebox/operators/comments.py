"""Comments on diff lines and on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_added_lines(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """Added lines with their comments (left join on the new line number); others stay without."""
    c = comments.select(F.col("file_path").alias("c_path"), F.col("line").alias("c_line"), *[x for x in comments.columns if x not in ("file_path", "line")])
    return lines.join(c, (lines["file_path"] == c["c_path"]) & (lines["new_line"] == c["c_line"]) & (lines["kind"] == "add"), "left").drop("c_path", "c_line")


def consume_once(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """Each comment's one line: the first that matches by its new number, or by its old if that is all it has.

    comments: file_path, line, comment_id; lines: file_path, pos, kind, old_line, new_line.
    """
    own = F.when(F.col("kind") == "del", F.col("old_line")).otherwise(F.col("new_line"))
    at = lines.withColumn("line", own).select("file_path", "line", "pos", "kind")
    first = at.groupBy("file_path", "line").agg(F.min(F.struct("pos", "kind")).alias("first"))
    return comments.join(first, ["file_path", "line"]).select(*comments.columns, F.col("first.pos").alias("pos"), F.col("first.kind").alias("kind"))


def merge_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """files with the comments that the state has for their path (its first row of a path), else their own."""
    first = state.groupBy("file_path").agg(F.min_by("comments", "ord").alias("newer"))
    return files.join(first, "file_path", "left").select("file_path", "hunks", F.coalesce("newer", "comments").alias("comments"))


def append_streamed(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """files (file_path, idx, comments) with incoming comments (file_path, seq, comment) added to the last file of their path."""
    last = files.groupBy("file_path").agg(F.max("idx").alias("idx"))
    new = incoming.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "comment"))), lambda x: x["comment"]).alias("new"))
    return files.join(last.join(new, "file_path"), ["file_path", "idx"], "left").select("file_path", "idx", F.concat("comments", F.coalesce("new", F.array().cast("array<string>"))).alias("comments"))


def ordinals(comments: DataFrame) -> DataFrame:
    """comment-<file>-<line>-<place in the line>."""
    n = F.row_number().over(Window.partitionBy("file_path", "line").orderBy("ord")) - 1
    name = F.concat_ws("-", F.lit("comment"), F.regexp_replace("file_path", "[^A-Za-z0-9]", "_"), F.col("line").cast("string"), n.cast("string"))
    return comments.withColumn("comment_id", name)


def unique_suffix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) with the one file that is the path or ends with it, whatever the case; none if several do.

    Files are posted under each of their trailing paths, so this is an equi-join.
    """
    parts = F.split("file_path", "/")
    tails = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("tail"))
    tails = tails.groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("one"))
    exact = files.select(F.col("file_path").alias("path"), F.lit(True).alias("exact"))
    out = wanted.join(exact, "path", "left").join(tails, F.lower("path") == F.col("tail"), "left")
    return out.select("path", F.when(F.col("exact"), F.col("path")).when(F.col("n") == 1, F.col("one")).alias("file_path"))


def excerpt(lines: DataFrame, radius: int) -> DataFrame:
    """Each line with the lines around it, its own marked by >."""
    around = Window.partitionBy("file_path").orderBy("pos").rowsBetween(-max(0, radius), max(0, radius))
    mine: Column = F.collect_list(F.struct("pos", "content")).over(around)
    return lines.withColumn("excerpt", F.array_join(F.transform(mine, lambda x: F.concat(F.when(x["pos"] == F.col("pos"), F.lit("> ")).otherwise(F.lit("  ")), x["content"])), "\n"))


def neighbours(comments: DataFrame) -> DataFrame:
    """The next and the previous comment of each file, around the end."""
    w = Window.partitionBy("file_path").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return comments.withColumn("next_content", F.coalesce(F.lead("content").over(w), F.first("content").over(whole))).withColumn("prev_content", F.coalesce(F.lag("content").over(w), F.last("content").over(whole)))
