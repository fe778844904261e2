"""Commit history as the table ``review_log``.

A dump is the text of ``git log`` with seven fields (hash, short hash, author,
e-mail, author date, subject, body), joined by the unit separator, and records
ended by the record separator.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

FIELD, RECORD = "\x1f", "\x1e"
SCHEMA = "hash string, short_hash string, author string, email string, date string, branch string, subject string, action string, iterations bigint, coverage bigint"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each record of the dumps at path."""
    return spark.read.option("lineSep", RECORD).text(path)


def parse(raw: DataFrame, tool: str, branch: str = "main", commit_date: bool = False) -> DataFrame:
    """review_log of raw records with the trailers of one tool; blank records and those of fewer than seven fields are dropped.

    The date is the author's; git bounds ``--since`` and ``--until`` by the
    committer's, which an eighth field may hold (``commit_date``).
    """
    parts = F.split("value", FIELD)
    rows = raw.where((X.strip("value") != "") & (F.size(parts) >= 7)).select(parts.alias("p"))
    p: Column = F.col("p")
    rest = X.trailer_line(p[6], tool)
    more = [X.utc_text(F.get("p", F.lit(7))).alias("commit_date")] if commit_date else []
    return rows.select(
        X.strip(p[0]).alias("hash"),
        X.strip(p[1]).alias("short_hash"),
        p[2].alias("author"),
        p[3].alias("email"),
        X.utc_text(p[4]).alias("date"),
        F.lit(branch).alias("branch"),
        p[5].alias("subject"),
        X.trailer_action(rest).alias("action"),
        X.trailer_metric(rest, 1).alias("iterations"),
        X.trailer_metric(rest, 2).alias("coverage"),
        *more,
    )


#: Days of the units that relative times are given in; a month and a year are taken by the calendar.
_UNITS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7}


def moment(text: str, now: datetime | None = None) -> str:
    """A bound as UTC text: an ISO date or time, ``now``, ``today``, ``yesterday``, or spans before now such as ``2 weeks 1 day ago``."""
    now = (now or datetime.now(UTC)).astimezone(UTC)
    words = text.strip().lower().replace(".", " ").replace(",", " ").split()
    at = None
    if words in (["now"], ["today"]):
        at = now
    elif words == ["yesterday"]:
        at = now - timedelta(days=1)
    elif words and words[-1] == "ago" and len(words) % 2:
        at = now
        for n, unit in zip(words[:-1:2], words[1:-1:2], strict=True):
            count, unit = int({"a": 1, "an": 1, "one": 1}.get(n, n)), unit.removesuffix("s")
            if unit in ("month", "year"):
                month = at.year * 12 + at.month - 1 - count * (12 if unit == "year" else 1)
                # A day that the month lacks runs over into the next one.
                at = at.replace(year=month // 12, month=month % 12 + 1, day=1) + timedelta(days=at.day - 1)
            else:
                at -= timedelta(days=count * _UNITS[unit])
    else:
        at = datetime.fromisoformat(text.strip())
        at = at.replace(tzinfo=at.tzinfo or UTC).astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def bounded(log: DataFrame, start: str | None = None, end: str | None = None, author: str | None = None, action: str | None = None, by: str = "date") -> DataFrame:
    """Rows between two times (see moment), of an author (regular expression) and of an action; ``by`` is the column that the times bound."""
    if start:
        log = log.where(F.col(by) >= moment(start))
    if end:
        log = log.where(F.col(by) <= moment(end))
    if author:
        log = log.where(F.concat(F.col("author"), F.lit(" <"), F.col("email"), F.lit(">")).rlike(author))
    return log.where(F.col("action") == action) if action else log


def since_relative(log: DataFrame, text: str, now: Column | None = None) -> DataFrame:
    """Rows since a span before now, such as ``2 weeks ago``."""
    n, unit = text.split()[:2]
    return log.where(F.to_timestamp("date") >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(n)} {unit}"))


def in_range(log: DataFrame, left: DataFrame, right: DataFrame, symmetric: bool = False) -> DataFrame:
    """Rows reachable from ``right`` but not from ``left`` (both have hash); symmetric: from just one of them."""
    only_right = right.select("hash").distinct().join(left, "hash", "left_anti")
    wanted = only_right
    if symmetric:
        wanted = only_right.unionByName(left.select("hash").distinct().join(right, "hash", "left_anti"))
    return log.join(wanted, "hash", "left_semi")


def touching(log: DataFrame, changes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose commit changes a path under prefix (changes: hash, path)."""
    return log.join(changes.where(F.col("path").startswith(prefix)), "hash", "left_semi")
