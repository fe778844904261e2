"""Incremental review coverage: which lines of a change earlier reviews have seen.

Sessions hold the files and hunk ranges that a review looked at, trees are
compared through the tables of changed files and changed ranges.  One plan does
all sessions and branches at once.  A line of a changed file is uncovered only if
it is new against every tree that has looked at the file, so the trees are counted:
all of a file's, and those in whose changed ranges the line stands.  Ranges are
events on the file's lines, summed in line order; lines never meet trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILES = "array<struct<file_path:string,hunks:array<struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int>>>>"


def file_hunks(sessions: DataFrame, *keys: str) -> DataFrame:
    """keys, file_path and hunk of all sessions; sessions whose file list cannot be read have none."""
    files = sessions.select(*keys, F.explode(F.from_json("diff_files", FILES)).alias("f"))
    return files.select(*keys, F.col("f.file_path").alias("file_path"), F.explode("f.hunks").alias("hunk"))


def new_lines(start: Column, count: Column) -> Column:
    """The numbers of a range's lines; none for a count of 0."""
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))


def lines(hunks: DataFrame, *keys: str) -> DataFrame:
    return hunks.select(*keys, "file_path", F.explode(new_lines(F.col("hunk.new_start_line"), F.col("hunk.new_line_count"))).alias("line"))


def distinct_lines(hunks: DataFrame, *keys: str) -> DataFrame:
    """keys, file_path, n_lines and first_line of all files with lines; a line of two hunks counts once.

    Ranges are counted in the order of their starts, so no row is made for a line.
    """
    start, end = F.col("hunk.new_start_line").cast("long"), (F.col("hunk.new_start_line").cast("long") + F.col("hunk.new_line_count") - 1)
    ranges = hunks.where("hunk.new_line_count > 0 AND hunk.new_start_line IS NOT NULL").select(*keys, "file_path", start.alias("start"), end.alias("end"))
    before = Window.partitionBy(*keys, "file_path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("from", F.greatest("start", F.max("end").over(before) + 1))
    return ranges.groupBy(*keys, "file_path").agg(F.sum(F.greatest(F.col("end") - F.col("from") + 1, F.lit(0))).alias("n_lines"), F.min("start").cast("int").alias("first_line"))


def total_lines(hunks: DataFrame, *keys: str) -> DataFrame:
    """Lines of all ranges, counted with repeats."""
    return hunks.groupBy(*keys).agg(F.sum(F.greatest(F.col("hunk.new_line_count"), F.lit(0))).cast("long").alias("total_lines"))


def prior_coverage(sessions: DataFrame, current: DataFrame, tree_changes: DataFrame, changed_ranges: DataFrame) -> DataFrame:
    """Coverage of each current change by the reviewed sessions of its branch.

    current: branch, tree_hash, diff_files.  tree_changes: tree1, tree2,
    file_path.  changed_ranges: tree1, tree2, file_path, start, end (both in).
    Sessions of the same tree, and files that no session's tree differs in, cover
    all lines; a changed file that a session has looked at covers its lines
    outside the changed ranges.
    """
    own = current.select("branch", F.col("tree_hash").alias("tree2"), "diff_files")
    hunks = file_hunks(own, "branch", "tree2")
    # Lines are kept as distinct places: a line of two hunks is covered once.
    places = lines(hunks, "branch", "tree2").distinct()
    readable = sessions.where(F.col("action") == "reviewed").withColumn("ok", (F.col("diff_files") == "") | F.from_json("diff_files", FILES).isNotNull())
    # Sessions of one tree cover alike, but for the files they have looked at; an unreadable one counts for its own tree alone.
    trees = readable.groupBy("branch", F.col("tree_hash").alias("tree1")).agg(F.max("ok").alias("ok"))
    looked = file_paths(readable.where("ok"))
    # (tree1, tree2, file) that differ, among the pairs of trees that meet on a branch.
    pairs = trees.join(own.select("branch", "tree2").distinct(), "branch").where("ok or tree1 = tree2")
    files = places.select("branch", "tree2", "file_path").distinct().join(pairs, ["branch", "tree2"])
    changed = files.join(tree_changes, ["tree1", "tree2", "file_path"], "left_semi").where("tree1 <> tree2")
    unchanged = files.join(changed, ["branch", "tree1", "tree2", "file_path"], "left_anti").select("branch", "tree2", "file_path").distinct()
    seen = changed.join(looked, ["branch", "tree1", "file_path"], "left_semi")
    file = ["branch", "tree2", "file_path"]
    trees_of = seen.groupBy(*file).agg(F.count(F.lit(1)).alias("trees"))
    ends = F.array(F.struct(F.col("start").alias("line"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("line"), F.lit(-1).alias("step")))
    gone = seen.join(merged_ranges(changed_ranges), ["tree1", "tree2", "file_path"]).select(*file, F.explode(ends).alias("e")).select(*file, "e.line", "e.step")
    both = places.join(trees_of, file, "left_semi").select(*file, "line", F.lit(0).alias("step")).unionByName(gone)
    # All that stands at a line counts for it: a range that starts there and one that has ended before.
    to_line = Window.partitionBy(*file).orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    new_against = both.withColumn("new_against", F.sum("step").over(to_line)).where("step = 0")
    whole = places.join(unchanged, file, "left_semi")
    partly = new_against.join(trees_of, file).where("new_against < trees").select(*file, "line")
    covered = whole.unionByName(partly).distinct().groupBy("branch", "tree2").agg(F.count(F.lit(1)).alias("covered_lines"))
    counts = sessions.groupBy("branch").agg((F.count(F.lit(1)) + 1).alias("iterations"), F.count_if(F.col("action") == "reviewed").alias("prior_reviews"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = own.select("branch", "tree2").distinct().join(counts, "branch", "left").join(total_lines(hunks, "branch", "tree2"), ["branch", "tree2"], "left").join(covered, ["branch", "tree2"], "left")
    out = out.select("branch", F.col("tree2").alias("tree_hash"), F.coalesce("iterations", F.lit(1)).cast("long").alias("iterations"), zero("prior_reviews"), zero("total_lines"), zero("covered_lines"))
    return out.withColumn("prior_pct", F.coalesce(F.try_divide(F.col("covered_lines").cast("double"), F.col("total_lines").cast("double")) * 100, F.lit(0.0)))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (start, end, both in) of each pair of trees and file, those that overlap as one."""
    file = Window.partitionBy("tree1", "tree2", "file_path").orderBy("start", "end")
    before = F.max("end").over(file.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where("end >= start").withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("n", F.sum("new").over(file))
    return rows.groupBy("tree1", "tree2", "file_path", "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("n")


def file_paths(sessions: DataFrame) -> DataFrame:
    """branch, tree1 and file_path of all that the sessions looked at."""
    return sessions.select("branch", F.col("tree_hash").alias("tree1"), F.explode(F.from_json("diff_files", FILES)["file_path"]).alias("file_path")).distinct()
