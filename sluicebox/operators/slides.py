"""Summaries as timed slides: eligibility, chapters and progress."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Sections that a summary needs, and headings that begin them.
SECTIONS = {"overview": ["overview", "summary"], "technical highlights": ["technical highlights", "highlights"], "impact": ["impact", "risk", "risks"]}
MIN_WORDS, MIN_SECTION_WORDS = 20, 3


def section_of(heading: Column) -> Column:
    h = X.normal_heading(heading)
    out = F.lit(None).cast("string")
    for name, heads in SECTIONS.items():
        out = F.when(h.isin(heads), name).otherwise(out)
    return out


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line and heading (null for other lines)."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    return rows.withColumn("heading", F.when(F.col("line").rlike(r"^\s{0,3}#{1,6}\s+\S"), X.strip(F.regexp_extract("line", r"^\s{0,3}#{1,6}\s+(.*)$", 1))))


def eligibility(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, eligible and reason of each summary."""
    lines = markdown_lines(docs, key, text)
    part = F.sum(F.col("heading").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    lines = lines.withColumn("part", part)
    parts = lines.groupBy(key, "part").agg(section_of(F.max("heading")).alias("section"), F.sum(F.when(F.col("heading").isNull(), X.word_count(F.col("line"))).otherwise(0)).alias("words"))
    sections = parts.where("section is not null").groupBy(key, "section").agg(F.sum("words").alias("words"))
    of = sections.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("words") < MIN_SECTION_WORDS).alias("empty"))
    rows = docs.select(key, X.word_count(F.col(text)).alias("all_words")).join(of, key, "left")
    reason = F.when(F.col("all_words") == 0, "empty-summary").when(F.col("all_words") < MIN_WORDS, "too-short").when(F.coalesce("seen", F.lit(0)) < len(SECTIONS), "missing-required-sections").when(F.col("empty") > 0, "empty-required-sections").otherwise("ok")
    return rows.select(key, (reason == "ok").alias("eligible"), reason.alias("reason"))


#: What ends in a full stop without ending a sentence.
ABBREVIATIONS = ["e.g.", "i.e.", "etc.", "vs.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Inc.", "Ltd.", "No.", "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec."]
#: Words that label a list point.
LABELS = "Functionality|Risk|Impact|Recommendation|Action"
_FILE_POINT = r"^([A-Za-z0-9._/-]*\.[A-Za-z0-9]+(?::\d+)?)\s*[:\-–]\s*(.+)$"
_LABEL_POINT = rf"(?i)^({LABELS})\s*:\s*(.+)$"


def sentences(c: Column) -> Column:
    """The sentences of a paragraph: cut at white space after . ! or ? and before a capital or a digit.

    Not after an abbreviation, an ellipsis or an address, and not within backquotes.
    """
    short = "|".join(re.escape(x) for x in ABBREVIATIONS)
    cut = rf"(?<=[.!?])(?<!\b(?:{short}))(?<!\.\.\.)(?<!https?://\S{{1,400}})\s+(?=[\"'(\[]?[A-Z0-9])"
    quoted = cut + "(?=[^`]*(?:`[^`]*`[^`]*)*$)"
    parts = F.when(F.contains(c, F.lit("`")), F.split(c, quoted)).otherwise(F.split(c, cut))
    return F.filter(F.transform(parts, X.strip), lambda x: x != "")


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block, kind (heading, item, code, quote, table, rule, text) and body of each block of Markdown, in order."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    fence = F.col("line").rlike(r"^\s{0,3}```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(order))
    is_ = F.col("line").rlike
    kind = (
        F.when(fence | (F.col("fences") % 2 == 1), "code").when(X.strip("line") == "", "blank").when(is_(r"^\s{0,3}#{1,6}\s+\S"), "heading").when(is_(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$"), "rule")
        .when(is_(r"^\s*(?:[-*+•]|\d+[.)])\s+\S"), "item").when(is_(r"^\s{0,3}>"), "quote").when(is_(r"^\s{0,3}\|"), "table").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    before = F.coalesce(F.lag("kind").over(order), F.lit("blank"))
    opens = fence & (F.col("fences") % 2 == 1)
    # A line of text goes on with the text or item before it.
    start = F.col("kind").isin("heading", "rule", "item") | opens | (F.col("kind").isin("quote", "table") & (before != F.col("kind"))) | ((F.col("kind") == "text") & ~before.isin("text", "item"))
    rows = rows.withColumn("block", F.sum(start.cast("int")).over(order)).where("kind <> 'blank'")
    line = F.when(F.col("kind") == "code", F.col("line")).otherwise(X.strip("line"))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("t"))))
    first = F.min_by("kind", "pos")
    body = rows.groupBy(key, "block").agg(first.alias("kind"), parts.alias("p"))
    joined = lambda by: F.array_join(F.transform("p", lambda x: x["t"]), by)
    return body.select(key, "block", "kind", F.when(F.col("kind").isin("text", "item"), joined(" ")).otherwise(joined("\n")).alias("body"))


def slides(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The slides of each summary: key, n, kind, title, top (its chapter), content and read_seconds.

    A slide for each sentence of a paragraph and for each list item; a point about
    a file or with a label has one for each of its sentences; code, quotes, tables
    and rules are one each; a first-level heading that a summary begins with is an
    intro slide.  Other headings give the slides after them their title.
    """
    rows = blocks(docs, key, text)
    order = Window.partitionBy(key).orderBy("block")
    level = F.length(F.regexp_extract("body", r"^\s{0,3}(#{1,6})\s", 1))
    heading = X.strip(F.regexp_extract("body", r"^\s{0,3}#{1,6}\s+(.*?)(?:\s+#+)?\s*$", 1))
    rows = rows.withColumn("intro", (F.col("kind") == "heading") & (level == 1) & (F.row_number().over(order) == 1)).withColumn("h", F.when((F.col("kind") == "heading") & ~F.col("intro"), heading)).withColumn("level", level)
    rows = rows.withColumn("title", F.coalesce(F.last("h", ignorenulls=True).over(order), F.lit("")))
    # A chapter begins at a second-level heading; before any, at the first heading.
    tops = F.last(F.when(F.col("level") == 2, F.col("h")), ignorenulls=True).over(order)
    rows = rows.withColumn("top", F.coalesce(tops, F.first("h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    item = F.regexp_replace("body", r"^(?:[-*+•]|\d+[.)])\s+", "")
    point = F.when(F.col("kind") != "item", F.col("kind")).when(item.rlike(_FILE_POINT), "file-point").when(item.rlike(_LABEL_POINT), "label-point").otherwise("list")
    pattern = lambda regex, i: F.regexp_extract(item, regex, i)
    rows = rows.withColumn("point", F.when(F.col("intro"), "intro").when(F.col("kind") == "text", "sentence").when(F.col("kind").isin("quote", "table", "rule"), "block").otherwise(point)).where("intro or kind <> 'heading'")
    pieces = (
        F.when(F.col("point") == "intro", F.array(F.lit(""))).when(F.col("point") == "sentence", sentences(F.col("body"))).when(F.col("point") == "file-point", sentences(pattern(_FILE_POINT, 2)))
        .when(F.col("point") == "label-point", sentences(pattern(_LABEL_POINT, 2))).when(F.col("point") == "list", F.array(item)).otherwise(F.array("body"))
    )
    label = F.when(F.col("point") == "file-point", pattern(_FILE_POINT, 1)).when(F.col("point") == "label-point", pattern(_LABEL_POINT, 1)).otherwise("")
    title = F.when(F.col("intro"), heading).otherwise(F.col("title"))
    each = rows.select(key, "block", F.col("point").alias("kind"), title.alias("title"), F.when(F.col("intro"), "").otherwise(F.col("top")).alias("top"), label.alias("label"), F.posexplode(pieces).alias("piece", "content"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("block", "piece"))
    words = X.word_count(F.concat_ws(" ", "title", "content"))
    return each.select(key, n.alias("n"), "kind", "title", "top", "label", "content", X.read_seconds(words).alias("read_seconds"))


def remaining(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Slides with the reading time that is left from each on."""
    rest = Window.partitionBy(key).orderBy(F.desc("n"))
    return rows.withColumn("remaining_seconds", F.sum("read_seconds").over(rest))


def chapters(rows: DataFrame, key: str) -> DataFrame:
    """Runs of slides (n, title, top) of one chapter: a slide without one goes with the last named before it, or with the first of all."""
    order = Window.partitionBy(key).orderBy("n")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.nullif(X.strip(F.coalesce("top", F.lit(""))), F.lit(""))
    rows = rows.withColumn("named", named)
    rows = rows.withColumn("chapter", F.coalesce(F.last("named", ignorenulls=True).over(order), F.first("named", ignorenulls=True).over(whole), F.first("title").over(whole)))
    rows = rows.withColumn("island", F.sum(F.coalesce((F.col("chapter") != F.lag("chapter").over(order)).cast("int"), F.lit(1))).over(order))
    runs = rows.groupBy(key, "island", "chapter").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.count(F.lit(1)).alias("slide_count"))
    total = F.sum("slide_count").over(Window.partitionBy(key))
    return runs.withColumn("width_pct", F.col("slide_count") / total * 100).withColumn("offset_pct", (F.col("start") - F.min("start").over(Window.partitionBy(key))) / total * 100)


def progress(rows: DataFrame, key: str) -> DataFrame:
    """Where each slide's mark stands on a track that ends with one more unit for "complete"."""
    units = F.max("n").over(Window.partitionBy(key)) + 1
    return rows.withColumn("centre_pct", clamp((F.col("n") - 0.5) / units * 100)).withColumn("fill_pct", clamp(F.col("n") / units * 100))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
