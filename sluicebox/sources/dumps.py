"""Dumps of commit records as a data source of Spark: byte ranges, pushed filters, and statistics that skip ranges.

``spark.read.format("commit_dump")`` reads what ``read_dump`` and ``parse`` read,
from paths that pyarrow's file systems open (for stores that only Spark's own
readers reach, use those).  A file is cut in byte ranges; the reader of a range
goes to the first record that begins in it and reads its last one to the end,
so a record across a cut is read once.  Bounds, author and action are tested
before a record's row is made, and the message itself is kept only if asked for.
They are options of read(); with the option pushdown (and Spark's setting for it)
conditions of a query on the columns are pushed as well.  (Spark 4.1 keeps one set
of pushed conditions for a loaded source: load it once for each branch of a query
that filters it in another way.  The other options have no such limit.)

index() writes, for each byte range, its records and the least and greatest
value of columns.  A read with that index leaves out ranges that no bound or
condition can match.  Git writes records by time, so bounds of dates skip most.

Dates are RFC 3339, as git's ``%aI`` and ``%cI`` write them; others read as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.text import METRICS, OUTCOMES, trailer_prefix
from . import history

SPLIT_BYTES = 64 << 20
#: Bytes that are read from a file at once.
READ_BYTES = 1 << 20
ROWS = 4096
SPACES = " \t\n\x0b\f\r"
#: Columns whose least and greatest values an index holds.
INDEXED = ("date", "author", "action")
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")

#: What a pushed filter asks of a value.
_TESTS = {
    EqualTo: lambda f: lambda v: v == f.value,
    In: lambda f: lambda v, of=frozenset(f.value): v in of,
    GreaterThan: lambda f: lambda v: v > f.value,
    GreaterThanOrEqual: lambda f: lambda v: v >= f.value,
    LessThan: lambda f: lambda v: v < f.value,
    LessThanOrEqual: lambda f: lambda v: v <= f.value,
    StringStartsWith: lambda f: lambda v: v.startswith(f.value),
    IsNotNull: lambda f: lambda v: True,
}
#: Whether values between a least and a greatest one can pass a filter.
_MAY = {
    EqualTo: lambda f, lo, hi: lo <= f.value <= hi,
    In: lambda f, lo, hi: any(lo <= v <= hi for v in f.value),
    GreaterThan: lambda f, lo, hi: hi > f.value,
    GreaterThanOrEqual: lambda f, lo, hi: hi >= f.value,
    LessThan: lambda f, lo, hi: lo < f.value,
    LessThanOrEqual: lambda f, lo, hi: lo <= f.value,
    StringStartsWith: lambda f, lo, hi: lo[: len(f.value)] <= f.value <= hi[: len(f.value)],
}


def utc_text(text: str) -> str:
    """An RFC 3339 time as UTC text; empty where it is none."""
    text = text.strip(SPACES)
    try:
        return datetime.fromisoformat(text).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if _TIME.fullmatch(text) else ""
    except (ValueError, OverflowError):
        return ""


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int

    def __init__(self, file: str, start: int, stop: int):
        super().__init__(start)
        self.file, self.start, self.stop = file, start, stop


def _records(part: Range) -> Iterator[str]:
    """The records that begin in the byte range."""
    end = history.RECORD.encode()
    system, path = opened(part.file)
    with system.open_input_file(path) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        rest = b""
        skipping = part.start > 0
        while True:
            block = f.read(READ_BYTES)
            pieces = (rest + block).split(end)
            rest = pieces.pop()
            if not block:
                pieces, rest = [rest] if rest else [], b""
            for piece in pieces:
                begin, at = at, at + len(piece) + 1
                if skipping:
                    skipping = False
                elif begin >= part.stop:
                    return
                else:
                    yield piece.decode("utf-8", "replace")
            if not block:
                return


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or under a path, without hidden ones and marks."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(at, recursive=True))
    prefix = path[: path.index(at)] if at in path else ""
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.size and not re.search(r"/[._][^/]*$", f"/{x.path}"))


class DumpReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.tool, self.branch = options["tool"], options.get("branch", "main")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.index = options.get("index")
        date, own = ("date",), []
        for name, kind in (("from", GreaterThanOrEqual), ("to", LessThanOrEqual)):
            if options.get(name):
                own.append(kind(date, history.moment(options[name])))
        if options.get("action"):
            own.append(EqualTo(("action",), options["action"]))
        self.author = options.get("author")
        self.asked: list[Filter] = own
        self.pushed: list[Filter] = []

    def ranges(self) -> list[Range]:
        return [Range(file, at, min(size, at + self.split_bytes)) for file, size in files_of(self.path) for at in range(0, size, self.split_bytes)]

    def partitions(self) -> Sequence[InputPartition]:
        every = self.ranges()
        if not self.index:
            return every
        system, path = opened(self.index)
        rows = ds.dataset(path, filesystem=system, format="parquet").to_table().to_pylist()
        known = {(r["file"], r["start"]): r for r in rows if r["split_bytes"] == self.split_bytes}
        return [p for p in every if (p.file, p.start) not in known or self._may_match(known[p.file, p.start])]

    def _may_match(self, row: dict) -> bool:
        tests = [(f, f.attribute[0]) for f in self.asked + self.pushed if type(f) in _MAY and f.attribute[0] in INDEXED]
        return row["records"] > 0 and all(_MAY[type(f)](f, row[f"least_{c}"], row[f"greatest_{c}"]) for f, c in tests)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there is none
            return
        tests = [(f.attribute[0], _TESTS[type(f)](f)) for f in self.asked + self.pushed]
        author = re.compile(self.author) if self.author else None
        starts = re.compile(trailer_prefix(self.tool) + f"({'|'.join(OUTCOMES)})")
        metrics, rows = re.compile(METRICS, re.ASCII), []
        for raw in _records(partition):
            fields = raw.split(history.FIELD)
            if not raw.strip(SPACES) or len(fields) < 7:
                continue
            if author and not author.search(f"{fields[2]} <{fields[3]}>"):
                continue
            row = {"hash": fields[0].strip(SPACES), "short_hash": fields[1].strip(SPACES), "author": fields[2], "email": fields[3], "date": utc_text(fields[4]), "branch": self.branch, "subject": fields[5], "action": "none", "iterations": 0, "coverage": 0}
            for line in fields[6].split("\n"):
                if found := starts.match(line := line.strip(SPACES)):
                    row["action"] = OUTCOMES[found[1]]
                    if of := metrics.search(line, found.start(1)):
                        row["iterations"], row["coverage"] = int(of[1]), int(of[2])
                    break
            row |= {"commit_date": utc_text(fields[7]) if len(fields) > 7 else "", "body": fields[6], "split_file": partition.file, "split_start": partition.start}
            if all(test(row[c]) for c, test in tests):
                rows.append(tuple(row[c] for c in self.columns))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"iterations": pa.int64(), "coverage": pa.int64(), "split_start": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(list(v), kinds.get(c, pa.string())) for c, v in zip(self.columns, zip(*rows), strict=True)], names=self.columns)


class PushedDumpReader(DumpReader):
    """A reader that tests a query's conditions on the columns as well."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.pushed = []
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.pushed.append(f)
            else:
                yield f


class CommitDump(DataSource):
    """Options: tool (whose trailers count), branch, from, to, author, action, body, commitDate and splits (more columns), splitBytes, index, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "commit_dump"

    def _on(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def schema(self) -> str:
        more = [", commit_date string"] * self._on("commitDate") + [", body string"] * self._on("body") + [", split_file string, split_start long"] * self._on("splits")
        return history.SCHEMA + "".join(more)

    def reader(self, schema: StructType) -> DumpReader:
        kind = PushedDumpReader if self._on("pushdown") else DumpReader
        return kind({k.lower(): v for k, v in self.options.items()}, schema.names)


def read(spark: SparkSession, path: str, tool: str, **options: str) -> DataFrame:
    """review_log of the dumps at a path, with the options of CommitDump; bounds and filters among them are the reader's."""
    spark.dataSource.register(CommitDump)
    if options.get("pushdown") == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # Pushed always, as a loaded source keeps what was pushed to it last where a query pushes nothing.
    return spark.read.format("commit_dump").options(tool=tool, **options).load(path).where(F.col("hash").isNotNull())


def index(spark: SparkSession, path: str, tool: str, out: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Write the statistics of each byte range of the dumps at a path."""
    rows = read(spark, path, tool, splits="true", splitBytes=str(split_bytes))
    bounds = [f(c).alias(f"{word}_{c}") for c in INDEXED for f, word in ((F.min, "least"), (F.max, "greatest"))]
    stats = rows.groupBy(F.col("split_file").alias("file"), F.col("split_start").alias("start")).agg(F.count(F.lit(1)).alias("records"), *bounds)
    stats.withColumn("split_bytes", F.lit(split_bytes)).write.parquet(out)
