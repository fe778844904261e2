"""Unified diffs as columns: hunk headers, files, numbered lines, ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"


def hunk_ranges(diff: Column) -> Column:
    """All hunk headers of a diff as structs; a missing count is 1, an explicit 0 stays."""
    part = [F.regexp_extract_all(diff, F.lit(HUNK), F.lit(i)) for i in (1, 2, 3, 4)]
    count = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("int"), F.lit(1))
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(part, "abcd", strict=True)])
    return F.transform(zipped, lambda x: F.struct(x["a"].cast("int").alias("old_start_line"), count(x["b"]).alias("old_line_count"), x["c"].cast("int").alias("new_start_line"), count(x["d"]).alias("new_line_count")))


def diff_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """A row for each content line of each file's hunks, numbered on both sides.

    Columns: key, file_path, hunk, header, pos, kind (add, del, context), old_line,
    new_line, content.  The path is the first token that starts with ``b/``;
    context lines get one more space in front, as the renderer shows them.
    """
    rows = diffs.select(key, F.posexplode(F.split(diff, r"[\r\n]+")).alias("pos", "line")).where("line <> ''")
    order = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("file_no", F.sum(F.col("line").startswith("diff --git").cast("int")).over(order))
    path = F.when(F.col("line").startswith("diff --git"), F.regexp_extract("line", r"\sb/(\S+)", 1))
    rows = rows.withColumn("file_path", F.last(path, ignorenulls=True).over(order))
    head = F.col("line").rlike("^" + HUNK)
    rows = rows.where("file_no > 0").withColumn("hunk", F.sum(head.cast("int")).over(Window.partitionBy(key, "file_no").orderBy("pos")))
    first = F.first(F.when(head, F.col("line")), ignorenulls=True)
    within = Window.partitionBy(key, "file_no", "hunk").orderBy("pos")
    rows = rows.where("hunk > 0").withColumn("header", first.over(within))
    mark = F.substring("line", 1, 1)
    rows = rows.where(~head & mark.isin("+", "-", " "))
    kind = F.when(mark == "+", "add").when(mark == "-", "del").otherwise("context")
    start = lambda i: F.regexp_extract("header", HUNK, i).cast("int")
    running = lambda cond: F.coalesce(F.sum(cond.cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("kind", kind)
    old = F.when(F.col("kind") != "add", start(1) + running(F.col("kind") != "add"))
    new = F.when(F.col("kind") != "del", start(3) + running(F.col("kind") != "del"))
    content = F.when(F.col("kind") == "context", F.concat(F.lit(" "), "line")).otherwise(F.substring("line", 2, 1 << 30))
    return rows.select(key, "file_path", "hunk", "header", "pos", "kind", old.cast("int").alias("old_line"), new.cast("int").alias("new_line"), content.alias("content"))


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression over a path, whether it takes files back) of one ignore pattern.

    A pattern with a slash that is not its last character is anchored at the top;
    a trailing slash matches a folder's content; ``*`` and ``?`` stop at slashes
    and ``**`` does not; ``[...]`` is one of its characters but a slash, and none of
    them after ``!`` or ``^``; a backslash takes the next character as it is.
    """
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        elif p[i] == "[" and (end := p.find("]", i + 3 if p[i + 1 : i + 2] in ("!", "^") else i + 2)) > 0:
            inside = p[i + 1 : end]
            negated_class = inside[:1] in ("!", "^")
            members = re.sub(r"([\[\]\\&^])", r"\\\1", inside[1:] if negated_class else inside)
            out, i = out + (f"[^/{members}]" if negated_class else f"(?!/)[{members}]"), end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), negated


def ignore_lines(text: str) -> list[str]:
    """The patterns of an ignore file: its lines without carriage returns, blank lines and comments."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    return [x for x in lines if x.strip() and not x.strip().startswith("#")]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path excludes it."""
    out = F.lit(False)
    for p in patterns:
        regex, negated = ignore_regex(p)
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def diff_sections(diffs: DataFrame, key: str, diff: str, patterns: list[str]) -> DataFrame:
    """key, kept (the diff without ignored files) and excluded (their paths, in order)."""
    # Each section begins at its own header line; what stands before the first is kept.
    parts = F.split(F.regexp_replace(F.col(diff), r"(?m)^(?=diff --git a/)", "\u0000"), "\u0000")
    head = lambda x: F.regexp_extract(x, r"^diff --git a/(.+) b/(.+)", 2)
    out = lambda x: (head(x) != "") & ignored(head(x), patterns)
    return diffs.select(key, F.array_join(F.filter(parts, lambda x: ~out(x)), "").alias("kept"), F.transform(F.filter(parts, out), head).alias("excluded"))


def tree_changes(names: DataFrame) -> DataFrame:
    """tree1, tree2 and file_path of listings of changed names (tree1, tree2, names: a path a line)."""
    return names.select("tree1", "tree2", F.explode(F.split("names", r"[\r\n]+")).alias("file_path")).where("file_path <> ''").distinct()


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """tree1, tree2, file_path, start and end (both in) of the new side of each hunk of diffs between trees (tree1, tree2, diff).

    A hunk that only takes lines away has none.
    """
    parts = F.split(F.regexp_replace("diff", r"(?m)^(?=diff --git a/)", "\u0000"), "\u0000")
    sections = diffs.select("tree1", "tree2", F.explode(parts).alias("s")).withColumn("file_path", F.regexp_extract("s", r"^diff --git a/(.+) b/(.+)", 2)).where("file_path <> ''")
    hunks = sections.select("tree1", "tree2", "file_path", F.explode(hunk_ranges(F.col("s"))).alias("h")).where("h.new_line_count > 0")
    return hunks.select("tree1", "tree2", "file_path", F.col("h.new_start_line").alias("start"), (F.col("h.new_start_line") + F.col("h.new_line_count") - 1).alias("end"))
