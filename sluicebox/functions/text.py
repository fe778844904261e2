"""Text columns: trailers, messages, paths, words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The trailer line is a tool's name, this text, an outcome and optional metrics.
CHECK = "Pre-Commit Check:"
OUTCOMES = {"ran": "reviewed", "vouched": "vouched", "skipped": "skipped"}
METRICS = r"iter:(\d+),\s*coverage:(\d+)%"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def trailer_prefix(tool: str) -> str:
    """A regular expression for the start of the tool's trailers; the name is taken literally."""
    return rf"^{re.escape(tool)} {CHECK}\s*"


def trailer_line(body: Column, tool: str) -> Column:
    """The first line of a message that is a well-formed trailer of the tool, without its prefix (null: none)."""
    lines, prefix = F.transform(F.split(body, "\n"), strip), trailer_prefix(tool)
    pattern = prefix + "(" + "|".join(OUTCOMES) + ")"
    return F.regexp_replace(F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1)), prefix, "")


def trailer_action(rest: Column) -> Column:
    out = F.lit("none")
    for word, action in OUTCOMES.items():
        out = F.when(rest.startswith(word), F.lit(action)).otherwise(out)
    return out


def trailer_metric(rest: Column, group: int) -> Column:
    """Iterations (group 1) or coverage (group 2); 0 unless both are there."""
    return F.coalesce(F.nullif(F.regexp_extract(rest, METRICS, group), F.lit("")).cast("long"), F.lit(0).cast("long"))


def format_trailer(action: Column, iterations: Column, pct: Column, tool: str) -> Column:
    """The trailer line of an outcome; metrics only after a first iteration, percentages rounded half up."""
    word = F.coalesce(*[F.when(action == a, F.lit(w)) for w, a in OUTCOMES.items()], action)
    metrics = F.concat(F.lit(" (iter:"), iterations.cast("string"), F.lit(", coverage:"), F.floor(pct + 0.5).cast("string"), F.lit("%)"))
    return F.concat(F.lit(f"{tool} {CHECK} "), word, F.when(iterations > 0, metrics).otherwise(F.lit("")))


def utc_text(c: Column) -> Column:
    """An RFC 3339 time as UTC text; the empty text where it cannot be read. The session's zone must be UTC."""
    return F.coalesce(F.date_format(F.try_to_timestamp(strip(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def sanitize_message(c: Column) -> Column:
    """Without line ends at the end and without control characters but newline and tab."""
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+$", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def initial_message(c: Column, tool: str) -> Column:
    """The lines of a message that are no comment, no trailer of the tool and not blank."""
    keep = F.filter(F.split(c, "\n"), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & ~strip(x).rlike(trailer_prefix(tool)))
    return strip(F.array_join(keep, "\n"))


def first_heading(c: Column) -> Column:
    """The text of the first Markdown heading, or the empty text."""
    return strip(F.regexp_extract(c, r"(?m)^\s*#+\s+(.+)$", 1))


def preview(c: Column, most: int) -> Column:
    """On one line and at most so many characters, the last one an ellipsis where it was cut."""
    flat = F.regexp_replace(strip(c), r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def capped_list(items: Column, most: int) -> Column:
    """The first items joined by commas, and how many more there are."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)


def word_count(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def read_seconds(words: Column) -> Column:
    """Reading time of a slide: 3.5 s and a word more each 1/3.2 s, from 5 to 12 s."""
    return F.least(F.greatest(F.floor(F.lit(3.5) + words / F.lit(3.2) + F.lit(0.5)), F.lit(5)), F.lit(12)).cast("long")


def normal_heading(c: Column) -> Column:
    """Lower-case ASCII words of a heading, joined by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def file_id(c: Column) -> Column:
    return F.concat(F.lit("file_"), F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


def duration(ms: Column) -> Column:
    """Milliseconds as hours and minutes, minutes and seconds, or seconds; null or negative: the empty text."""
    s = F.floor(ms / 1000.0 + 0.5).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    hours = F.concat(h.cast("string"), F.lit("h"), F.when(m > 0, F.concat(F.lit(" "), m.cast("string"), F.lit("m"))).otherwise(F.lit("")))
    minutes = F.concat(m.cast("string"), F.lit("m"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("s"))).otherwise(F.lit("")))
    return F.when(ms.isNull() | (ms < 0), F.lit("")).when(h > 0, hours).when(m > 0, minutes).otherwise(F.concat(s.cast("string"), F.lit("s")))


def semver(c: Column) -> Column:
    """(major, minor, patch) of the first version number in a text, or null."""
    part = lambda i: F.regexp_extract(c, r"v?(\d+)\.(\d+)\.(\d+)", i).cast("int")
    return F.when(c.rlike(r"v?\d+\.\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def likely_auto_name(c: Column, prefixes: list[str], words: list[str]) -> Column:
    """Whether a name looks generated: a known prefix and a number, or two known words (and a number)."""
    any_ = "|".join(words) or "(?!)"
    return F.lower(strip(c)).rlike(rf"^(?:{'|'.join(prefixes) or '(?!)'})[-_ ]?\d*$") | F.lower(strip(c)).rlike(rf"^(?:{any_})[-_ ](?:{any_})(?:[-_ ]?\d+)?$")


def initials(first: Column, last: Column, email: Column) -> Column:
    """Two initials from the names, else the first letter of the address, else a question mark."""
    both = F.concat(F.substring(strip(F.coalesce(first, F.lit(""))), 1, 1), F.substring(strip(F.coalesce(last, F.lit(""))), 1, 1))
    return F.upper(F.coalesce(F.nullif(both, F.lit("")), F.nullif(F.substring(strip(F.coalesce(email, F.lit(""))), 1, 1), F.lit("")), F.lit("?")))


def positive_id(c: Column) -> Column:
    """An id given as number or text, if it is a whole number over 0."""
    n = F.when(strip(c.cast("string")).rlike(r"^\d{1,18}$"), strip(c.cast("string")).cast("long"))
    return F.when(n > 0, n)
