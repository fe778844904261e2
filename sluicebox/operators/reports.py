"""Review results as texts: reports with comments beside their lines, usage lines, issue lists, event logs, vulnerability tables.

A report is built bottom up: a text for each comment, then for each hunk and
file, then for each review, always in the order of the given numbers.  So a group
is never more than one review's own text.

results: review, summary.  files: review, file_no (from 1), file_path.  comments:
review, file_no, pos (order in the file), line, severity, confidence, type,
category, subcategory, content.  lines: as functions.diff.diff_lines gives them,
with review and file_no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diff import hunk_ranges
from ..functions.text import strip

WIDE = 80
#: Fixed value: what a reader searches for to jump from comment to comment.
MARKER = ">>>COMMENT<<<"
#: How the plans run the models.
AI_MODES = {"free_30k": "BYOK required on free plan", "team_32usd": "Auto by default on team plan (BYOK optional)"}


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _rule(ch: str) -> str:
    return ch * WIDE + "\n"


def joined(order: Column | str, text: Column | str, between: str = "") -> Column:
    """An aggregate: a group's texts in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, (F.col(text) if isinstance(text, str) else text).alias("text"))))
    return F.array_join(F.transform(parts, lambda x: x["text"]), between)


def comment_head() -> Column:
    """[SEVERITY] Line n (category), and the tags on a line of their own."""
    tag = lambda c: F.when(_text(c) != "", F.concat(F.lit(f" {c}="), F.col(c))).otherwise(F.lit(""))
    tags = F.concat(tag("confidence"), tag("type"), tag("subcategory"))
    severity = F.upper(F.coalesce(F.nullif(_text("severity"), F.lit("")), F.lit("info")))
    category = F.when(_text("category") != "", F.concat(F.lit(" ("), F.col("category"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), severity, F.lit("] Line "), F.col("line").cast("string"), category, F.when(tags != "", F.concat(F.lit("\n    Tags:"), tags)).otherwise(F.lit("")))


def _indented(c: str, by: str) -> Column:
    return F.array_join(F.transform(F.split(_text(c), "\n"), lambda x: F.concat(F.lit(by), x, F.lit("\n"))), "")


def _by_review(results: DataFrame, of_files: DataFrame, comments: DataFrame) -> DataFrame:
    """review, summary, n_files, n_comments and body (the files' texts in order) of each result."""
    body = of_files.groupBy("review").agg(joined("file_no", "text").alias("body"), F.count(F.lit(1)).alias("n_files"))
    n = comments.groupBy("review").agg(F.count(F.lit(1)).alias("n_comments"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return results.join(body, "review", "left").join(n, "review", "left").select("review", _text("summary").alias("summary"), _text("body").alias("body"), zero("n_files"), zero("n_comments"))


def pretty(results: DataFrame, files: DataFrame, comments: DataFrame, title: str) -> DataFrame:
    """review and text: the result as sections for a terminal."""
    one = F.concat(F.lit("\n  "), comment_head(), F.lit("\n"), _indented("content", "    "))
    own = comments.groupBy("review", "file_no").agg(joined("pos", one).alias("own"))
    head = F.concat(F.lit("\n" + _rule("-") + "FILE: "), F.col("file_path"), F.lit("\n" + _rule("-")))
    of_files = files.join(own, ["review", "file_no"], "left").select("review", "file_no", F.concat(head, F.coalesce("own", F.lit("  No comments for this file.\n"))).alias("text"))
    rows = _by_review(results, of_files, comments)
    summary = F.when(F.col("summary") != "", F.concat(F.lit("\nSummary:\n"), F.col("summary"), F.lit("\n"))).otherwise(F.lit(""))
    some = F.concat(F.lit("\n"), F.col("n_files").cast("string"), F.lit(" file(s) with comments:\n"), F.col("body"), F.lit("\n" + _rule("=") + "Review complete: "), F.col("n_comments").cast("string"), F.lit(" total comment(s)\n" + _rule("=") + "\n"))
    none = F.lit("\nNo files reviewed or no comments generated.\n")
    return rows.select("review", F.concat(F.lit(f"\n{_rule('=')}{title}\n{_rule('=')}"), summary, F.when(F.col("n_files") == 0, none).otherwise(some)).alias("text"))


def hunk_texts(lines: DataFrame, comments: DataFrame) -> DataFrame:
    """review, file_no, hunk and text: numbered lines, and after an added line the comments on it."""
    one = F.concat(F.lit(f"\n{MARKER} "), comment_head(), F.lit("\n" + _rule("-")), _indented("content", "  "), F.lit(_rule("-") + "\n"))
    on_line = comments.groupBy("review", "file_no", F.col("line").alias("new_line")).agg(joined("pos", one).alias("notes"), F.lit("add").alias("kind"))
    number = lambda c: F.coalesce(F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(4)), F.lit(" ")), F.lit("    "))
    mark = F.when(F.col("kind") == "add", "+").when(F.col("kind") == "del", "-").otherwise("")
    noted = lines.join(on_line, ["review", "file_no", "new_line", "kind"], "left")
    line = F.concat(number("old_line"), F.lit(" | "), number("new_line"), F.lit(" | "), mark, F.col("content"), F.lit("\n"), _text("notes"))
    rows = noted.groupBy("review", "file_no", "hunk").agg(F.first("header").alias("header"), joined("pos", line).alias("body"))
    h = hunk_ranges(F.col("header"))[0]
    part = lambda name: h[name].cast("string")
    # A count of 0 is shown as 1.
    count = lambda name: F.greatest(h[name], F.lit(1)).cast("string")
    at = F.concat(F.lit(_rule("-") + "@@ -"), part("old_start_line"), F.lit(","), count("old_line_count"), F.lit(" +"), part("new_start_line"), F.lit(","), count("new_line_count"), F.lit(" @@\n" + _rule("-")))
    return rows.select("review", "file_no", "hunk", F.concat(at, F.col("body"), F.lit("\n")).alias("text"))


def with_comments(results: DataFrame, files: DataFrame, lines: DataFrame, comments: DataFrame, title: str, generated: str) -> DataFrame:
    """review and text: all hunks of the files that have comments, with the comments beside their lines."""
    hunks = hunk_texts(lines, comments).groupBy("review", "file_no").agg(joined("hunk", "text", "\n").alias("hunks"))
    n = comments.groupBy("review", "file_no").agg(F.count(F.lit(1)).alias("n"))
    of = F.count(F.lit(1)).over(Window.partitionBy("review"))
    head = F.concat(F.lit("\n" + _rule("=") + "FILE "), F.col("file_no").cast("string"), F.lit("/"), of.cast("string"), F.lit(": "), F.col("file_path"), F.lit("\n" + _rule("=")))
    body = F.when(F.col("n").isNull(), F.lit("\n  No comments for this file.\n")).otherwise(F.concat(F.lit("\n  "), F.col("n").cast("string"), F.lit(" comment(s) on this file\n\n"), _text("hunks")))
    of_files = files.join(n, ["review", "file_no"], "left").join(hunks, ["review", "file_no"], "left").select("review", "file_no", F.concat(head, body).alias("text"))
    rows = _by_review(results, of_files, comments)
    top = f"{_rule('=')}{title} - TEXT FORMAT\n{_rule('=')}Generated: {generated}\n\nSearch for '{MARKER}' to jump between review comments\n{_rule('=')}\n"
    summary = F.when(F.col("summary") != "", F.concat(F.lit("SUMMARY:\n"), F.col("summary"), F.lit("\n\n"))).otherwise(F.lit(""))
    totals = F.concat(F.lit("TOTAL FILES: "), F.col("n_files").cast("string"), F.lit("\nTOTAL COMMENTS: "), F.col("n_comments").cast("string"), F.lit("\n\n"))
    middle = F.when(F.col("n_files") == 0, F.lit("No files reviewed or no comments generated.\n")).otherwise(F.col("body"))
    end = F.concat(F.lit("\n" + _rule("=") + "END OF REVIEW - "), F.col("n_comments").cast("string"), F.lit(" total comment(s)\n" + _rule("=")))
    return rows.select("review", F.concat(F.lit(top), summary, totals, middle, end).alias("text"))


COMMENT_FIELDS = ["line", "content", "severity", "confidence", "type", "category", "subcategory"]


def as_json(results: DataFrame, files: DataFrame, comments: DataFrame) -> DataFrame:
    """review and json: summary and files with their comments nested, in order (render.indented writes it over several lines)."""
    own = comments.groupBy("review", "file_no").agg(F.array_sort(F.collect_list(F.struct("pos", *COMMENT_FIELDS))).alias("c"))
    own = own.select("review", "file_no", F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in COMMENT_FIELDS])).alias("c"))
    rows = files.join(own, ["review", "file_no"], "left").withColumn("comments", F.coalesce("c", F.array().cast(own.schema["c"].dataType)))
    of = rows.groupBy("review").agg(F.array_sort(F.collect_list(F.struct("file_no", "file_path", "comments"))).alias("f"))
    listed = F.transform("f", lambda x: F.struct(x["file_path"].alias("file_path"), x["comments"].alias("comments")))
    return results.join(of, "review", "left").select("review", F.to_json(F.struct(_text("summary").alias("summary"), listed.alias("files"))).alias("json"))


def prepared(comments: DataFrame) -> DataFrame:
    """comments as a page shows them: severity in capitals (unknown ones kept), badge (info for those) and has_category."""
    low = F.lower(F.coalesce(F.nullif(_text("severity"), F.lit("")), F.lit("info")))
    badge = F.when(low.isin("info", "warning", "critical"), F.concat(F.lit("badge-"), low)).otherwise("badge-info")
    return comments.withColumns({"severity": F.upper(low), "badge": badge, "has_category": _text("category") != ""})


def slim(files: Column) -> Column:
    """A file list without the hunks' contents."""
    names = ("old_start_line", "old_line_count", "new_start_line", "new_line_count")
    return F.transform(files, lambda f: F.struct(f["file_path"].alias("file_path"), F.transform(f["hunks"], lambda h: F.struct(*[h[n].alias(n) for n in names])).alias("hunks")))


def usage_lines() -> Column:
    """Lines about a plan's use (plan_code, usage_percent, loc_used, loc_limit, loc_remain, reset_at, threshold_state, trial_readonly,
    blocked, billable_loc, operation_type, execution_mode, execution_source); what is unknown has none."""
    some = lambda label, c: F.when(_text(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    mode = F.lit(None).cast("string")
    for code, text in AI_MODES.items():
        mode = F.when(F.col("plan_code") == code, F.lit(f"ai_mode: {text}")).otherwise(mode)
    loc = F.concat(F.lit("loc_used/limit/remaining: "), known("loc_used"), F.lit("/"), known("loc_limit"), F.lit("/"), known("loc_remain"))
    return F.array_compact(
        F.array(
            some("plan_code", "plan_code"),
            mode,
            F.when(F.col("usage_percent").isNotNull(), F.concat(F.lit("usage_percent: "), F.col("usage_percent").cast("string"), F.lit("%"))),
            F.when(F.coalesce("loc_used", "loc_limit", "loc_remain").isNotNull(), loc),
            some("reset_at", "reset_at"),
            some("threshold_state", "threshold_state"),
            F.when(F.col("trial_readonly"), "trial_readonly: true"),
            F.when(F.col("blocked"), "blocked: true"),
            F.when(F.col("billable_loc").isNotNull(), F.concat(F.lit("operation_billable_loc: "), F.col("billable_loc").cast("string"))),
            some("operation_type", "operation_type"),
            some("ai_execution_mode", "execution_mode"),
            some("ai_execution_source", "execution_source"),
        )
    )


def issue_line() -> Column:
    """path:line — content (severity, category)."""
    at = F.concat(F.col("file_path"), F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(F.lit("")))
    category = F.when(_text("category") != "", F.concat(F.lit(", "), F.col("category"))).otherwise(F.lit(""))
    label = F.when(_text("severity") != "", F.concat(F.lit(" ("), F.col("severity"), category, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(at, F.lit(" — "), _text("content"), label)


def issue_list(comments: DataFrame, *keys: str) -> DataFrame:
    """keys and text: each group's issues by ord, numbered, with blank lines between."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    rows = comments.withColumn("text", F.concat(n.cast("string"), F.lit(". "), issue_line()))
    return rows.groupBy(*keys).agg(joined("ord", "text", "\n\n").alias("text"))


def event_log(events: DataFrame, *keys: str) -> DataFrame:
    """keys and text: each group's events (seq, time, type, message) by seq, as [n] time - TYPE and the message."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    kind = F.upper(F.coalesce(F.nullif(_text("type"), F.lit("")), F.lit("log")))
    rows = events.withColumn("text", F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce(F.date_format("time", "HH:mm:ss"), F.lit("")), F.lit(" - "), kind, F.lit("\n  "), _text("message")))
    return rows.groupBy(*keys).agg(joined("seq", "text", "\n\n").alias("text"))


def distinct_lines(lines: Column) -> Column:
    """The texts of an array without blank ones and without those that an earlier one equals but for case and white space."""
    trimmed = F.filter(F.transform(lines, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    normal = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    keys = F.transform(trimmed, normal)
    return F.filter(trimmed, lambda x, i: F.array_position(keys, normal(x)) == i + 1)


def newly_commented(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (file_path, n) that have comments now and had none before, or were not there."""
    had = before.where("n > 0").select("file_path")
    return now.where("n > 0").join(had, "file_path", "left_anti")


OSV_COLUMNS = ["go_id", "cve", "aliases", "summary", "package", "symbols", "introduced", "fixed", "called", "source_path", "disposition", "fix_track", "notes"]


def write_osv_csv(rows: DataFrame, path: str) -> None:
    """The rows by their id, as CSV with a header; quotes are doubled."""
    rows.select(OSV_COLUMNS).orderBy("go_id").write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def osv_markdown(rows: DataFrame, source: str) -> DataFrame:
    """part, go_id and line of a Markdown report, in its order: the counts, the rules and a table of the rows by their id."""
    of = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.count_if(F.col("called") == x), F.lit(0)).alias(x) for x in ("true", "false")])
    number = lambda label, c: F.concat(F.lit(f"- {label}: "), c.cast("string"))
    top = ["# OSV Triage Matrix", "", f"Source report: `{source}`", ""]
    rules = [
        "", "## Initial Disposition Rules", "", "- `actionable-now`: scanner marked called=true; treat as reachable until disproven.", "- `verify-reachability`: scanner marked called=false; confirm by code-path review.",
        "", "## Vulnerability Table", "", "| GO ID | CVE | Called | Summary | Fixed Versions | Disposition | Fix Track |", "|---|---|---|---|---|---|---|",
    ]
    counts = [number("Total vulnerabilities", F.col("n")), number("Called true", F.col("true")), number("Called false", F.col("false")), number("Called unknown", F.col("n") - F.col("true") - F.col("false"))]
    head = of.select(F.posexplode(F.array(*map(F.lit, top), *counts, *map(F.lit, rules))).alias("part", "line")).select("part", F.lit("").alias("go_id"), "line")
    safe = lambda c: F.replace(_text(c), F.lit("|"), F.lit("\\|"))
    cells = [F.col("go_id"), F.coalesce(F.nullif(_text("cve"), F.lit("")), F.lit("-")), F.col("called"), safe("summary"), safe("fixed"), F.col("disposition"), F.col("fix_track")]
    table = rows.select(F.lit(len(top) + len(counts) + len(rules)).alias("part"), "go_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(table).orderBy("part", "go_id")
