"""A log of review events as a stream source with its own bookmark.

``spark.readStream.format("review_events")`` follows a folder of Parquet files of
events (with the column ``time``) that others append to.  Its offset is the time
of the latest event; the next batch starts a second before the bookmark, as
events may come that late, and gives those of the overlap again: drop repeats
with events.deduplicate.  Files are split by row groups, whose statistics tell
which of them a batch needs, and rows are handed over in pages.  The offset is in
the query's checkpoint, so a query that is stopped goes on where it was.  Paths
are those that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..sources.dumps import files_of, opened

PAGE_ROWS = 1000
OVERLAP_MS = 1000


class Rows(InputPartition):
    """Row group of a file, and the times that are wanted of it."""

    def __init__(self, file: str, group: int, since: str, until: str):
        super().__init__(group)
        self.file, self.group, self.since, self.until = file, group, since, until


def _text(t: datetime) -> str:
    return (t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)).isoformat(timespec="microseconds")


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.page = int(options.get("pagerows", PAGE_ROWS))
        self.overlap = timedelta(milliseconds=int(options.get("overlapms", OVERLAP_MS)))

    def _groups(self) -> Iterator[tuple[str, int, str, str]]:
        """(file, row group, first time, last time); without statistics the column is read."""
        for file, _ in files_of(self.path):
            system, path = opened(file)
            with system.open_input_file(path) as f:
                parquet = pq.ParquetFile(f)
                at = parquet.schema_arrow.names.index("time")
                for g in range(parquet.metadata.num_row_groups):
                    stats = parquet.metadata.row_group(g).column(at).statistics
                    if stats is not None and stats.has_min_max:
                        yield file, g, _text(stats.min), _text(stats.max)
                    else:
                        times = parquet.read_row_group(g, columns=["time"]).column("time")
                        if len(times) > times.null_count:
                            yield file, g, _text(pc.min(times).as_py()), _text(pc.max(times).as_py())

    def initialOffset(self) -> dict:
        return {"seen": ""}

    def latestOffset(self) -> dict:
        return {"seen": max((last for *_, last in self._groups()), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["seen"] >= end["seen"]:
            return []
        since = _text(datetime.fromisoformat(start["seen"]) - self.overlap) if start["seen"] else ""
        return [Rows(file, g, since, end["seen"]) for file, g, first, last in self._groups() if last >= since and first <= end["seen"]]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.file)
        with system.open_input_file(path) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.group, columns=self.names)
        time = rows.column("time")
        bound = lambda text: pa.scalar(datetime.fromisoformat(text).replace(tzinfo=None) if time.type.tz is None else datetime.fromisoformat(text), time.type)
        wanted = pc.less_equal(time, bound(partition.until))
        if partition.since:
            wanted = pc.and_(wanted, pc.greater_equal(time, bound(partition.since)))
        yield from rows.filter(wanted).select(self.names).combine_chunks().to_batches(max_chunksize=self.page)


class ReviewEvents(DataSource):
    """Options: path, pageRows, overlapMs."""

    @classmethod
    def name(cls) -> str:
        return "review_events"

    def schema(self) -> StructType:
        file = files_of(self.options["path"])[0][0]
        system, path = opened(file)
        with system.open_input_file(path) as f:
            return from_arrow_schema(pq.read_schema(f))

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader({k.lower(): v for k, v in self.options.items()}, schema)
