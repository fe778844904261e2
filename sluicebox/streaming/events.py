"""Review event streams: identity, de-duplication, bookmarks, comments, status.

The functions take batch and streaming DataFrames alike (id, type, time, level,
batchId, data as JSON text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration, strip
from ..operators.facets import SEVERITIES

#: How long events may come late: what a poll looks back from its bookmark.
OVERLAP = "1 second"
LOADING = ["Reading the change", "Looking for issues", "Checking details", "Collecting comments"]


def event_key() -> Column:
    """The id (the empty one too), or for an event without one its parts and its number (seq); the keys of its data are put in order."""
    part = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    return F.coalesce(F.col("id"), F.concat(part("type", "event"), F.lit(":"), part("time", "unknown"), F.lit(":"), part("batchId", ""), F.lit(":"), F.coalesce(F.to_json(F.try_parse_json("data")), part("data", "undefined")), F.lit(":"), part("seq", "")))


def deduplicate(events: DataFrame, within: str | None = None) -> DataFrame:
    """The first event of each key by seq; a stream takes the first to come, and with ``within`` forgets keys after so long."""
    keyed = events.withColumn("event_key", event_key())
    if events.isStreaming:
        return keyed.withWatermark("time", within).dropDuplicatesWithinWatermark(["event_key"]) if within else keyed.dropDuplicates(["event_key"])
    first = keyed.groupBy("event_key").agg(F.min_by(F.struct(*events.columns), "seq").alias("e"))
    return first.select(*[F.col("e")[c].alias(c) for c in events.columns], "event_key")


def bookmark(events: DataFrame, *keys: str) -> DataFrame:
    """Latest event time and where the next poll starts."""
    return events.groupBy(*keys).agg(F.max("time").alias("last_seen"), (F.max("time") - F.expr(f"INTERVAL {OVERLAP}")).alias("since"))


#: The spellings of a comment's fields; the first that is there counts.
SPELLINGS = {
    "is_internal": ("IsInternal", "isInternal", "is_internal"),
    "file_path": ("FilePath", "filePath", "file_path"),
    "line": ("Line", "line", "lineNumber", "line_number"),
    "content": ("Content", "content"),
    "severity": ("Severity", "severity"),
    "confidence": ("Confidence", "confidence"),
    "type": ("Type", "type"),
    "category": ("Category", "category"),
    "subcategory": ("Subcategory", "subcategory"),
}
DATA = "status string, errorSummary string, comments array<map<string,string>>"


def comment_fields(c: Column) -> list[Column]:
    """The fields of a comment (a map) whatever their spelling; of paths the first that is not empty."""
    get = lambda name, k: F.nullif(c[k], F.lit("")) if name == "file_path" else c[k]
    return [F.coalesce(*[get(name, k) for k in keys]).alias(name) for name, keys in SPELLINGS.items()]


def _external(c: Column) -> Column:
    """Whether a comment (a map) is one to show: not internal, with a path, a line and a text."""
    of = dict(zip(SPELLINGS, comment_fields(c), strict=True))
    internal = ~F.coalesce(F.lower(of["is_internal"]), F.lit("")).isin("", "false", "0")
    shown = ~internal & (F.coalesce(of["file_path"], F.lit("")) != "") & (of["line"].try_cast("double") > 0) & (strip(F.coalesce(of["content"], F.lit(""))) != "")
    return F.coalesce(shown, F.lit(False))


def _shown() -> Column:
    """The comments to show of a completed batch, with their places; null for other events."""
    d = F.from_json("data", DATA)
    placed = F.transform(d["comments"], lambda c, i: F.struct(i.alias("pos"), c.alias("c")))
    return F.when((F.col("type") == "batch") & (d["status"] == "completed"), F.filter(placed, lambda x: _external(x["c"])))


def comments(events: DataFrame) -> DataFrame:
    """External comments of completed batches, one row each, normalised."""
    rows = events.select("id", F.explode(_shown()).alias("x")).select("id", "x.pos", *comment_fields(F.col("x.c")))
    severity = F.lower(strip(F.coalesce("severity", F.lit("info"))))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    category = F.coalesce(F.nullif(text("category"), F.lit("")), F.lit("review"))
    return rows.select("id", "pos", "file_path", F.col("line").try_cast("double").cast("long").alias("line"), text("content").alias("content"), F.when(severity.isin(SEVERITIES[:2]), severity).otherwise("info").alias("severity"), text("confidence").alias("confidence"), text("type").alias("type"), category.alias("category"), text("subcategory").alias("subcategory"))


def status(events: DataFrame, *keys: str) -> DataFrame:
    """The status that the latest telling event gives (seq orders events)."""
    d = F.from_json("data", DATA)
    told = F.when((F.col("type") == "status") & (F.coalesce(d["status"], F.lit("")) != ""), d["status"]).when(F.col("type") == "completion", F.when(F.coalesce(d["errorSummary"], F.lit("")) != "", "failed").otherwise("completed"))
    return events.withColumn("told", told).groupBy(*keys).agg(F.coalesce(F.max_by("told", F.when(F.col("told").isNotNull(), F.col("seq"))), F.lit("")).alias("status"))


def _counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def message(events: DataFrame) -> DataFrame:
    """A line of the event log for each event; an unknown type shows its data."""
    d = F.from_json("data", "message string, status string, fileCount int, commentCount int, kind string, url string, resultSummary string")
    some = lambda name: F.nullif(d[name], F.lit(""))
    files, comments_ = (F.coalesce(d[x], F.lit(0)) for x in ("fileCount", "commentCount"))
    batch = F.concat(F.lit("Batch "), F.coalesce(F.nullif("batchId", F.lit("")), F.lit("unknown")))
    log = F.coalesce(d["message"], F.lit(""))
    for mark, meant in (("\\n", "\n"), ("\\t", "  "), ('\\"', '"')):
        log = F.replace(log, F.lit(mark), F.lit(meant))
    text = (
        F.when(F.col("type") == "log", log)
        .when((F.col("type") == "batch") & (d["status"] == "processing"), F.concat(batch, F.lit(" started: processing "), _counted(files, "file")))
        .when((F.col("type") == "batch") & (d["status"] == "completed"), F.concat(batch, F.lit(" completed: generated "), _counted(comments_, "comment")))
        .when(F.col("type") == "batch", F.concat(batch, F.lit(": "), F.coalesce(some("status"), F.lit("unknown status"))))
        .when(F.col("type") == "status", F.concat(F.lit("Status: "), F.coalesce(some("status"), F.lit("unknown"))))
        .when((F.col("type") == "artifact") & some("url").isNotNull(), F.concat(F.lit("Generated: "), F.coalesce(some("kind"), F.lit("artifact"))))
        .when(F.col("type") == "artifact", F.concat(F.lit("Artifact: "), F.coalesce(some("kind"), F.lit("unknown"))))
        .when(F.col("type") == "completion", F.coalesce(some("resultSummary"), F.concat(F.lit("Process completed with "), _counted(comments_, "comment"))))
    )
    return events.withColumn("message", F.coalesce(text, "data", F.lit("{}")))


def loading_line(elapsed_ms: Column) -> Column:
    """One of four lines, a new one each three seconds."""
    return F.element_at(F.array(*[F.lit(x) for x in LOADING]), (F.floor(elapsed_ms / 3000) % 4 + 1).cast("int"))


def performance(events: DataFrame, *keys: str) -> DataFrame:
    """Elapsed time (to completion or the latest event), time to the first comment with its label, and comments of each review."""
    rows = events.withColumns({"ms": F.unix_millis(F.col("time").cast("timestamp")), "n": F.coalesce(F.size(_shown()), F.lit(0))})
    rows = rows.groupBy(*keys).agg(F.min("ms").alias("baseline"), F.max("ms").alias("now"), F.min(F.when(F.col("n") > 0, F.col("ms"))).alias("first"), F.min(F.when(F.col("type") == "completion", F.col("ms"))).alias("completed"), F.sum(F.greatest("n", F.lit(0))).alias("total_comments"))
    elapsed = F.greatest(F.coalesce("completed", "now") - F.col("baseline"), F.lit(0))
    first = F.col("first") - F.col("baseline")
    label = F.when(first.isNotNull(), duration(first)).when(F.col("completed").isNotNull(), "No comments").otherwise("Waiting")
    return rows.select(*keys, elapsed.alias("elapsed_ms"), first.alias("first_comment_ms"), label.alias("first_comment"), "total_comments")


def maintain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Hand each micro-batch of new events to ``apply``; a batch that is run again has the same number."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
