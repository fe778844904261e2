"""Counts that are maintained batch by batch, and stay right where a batch runs twice.

Each micro-batch writes its own sums of signed changes under its number, in
place of what an earlier attempt of that number has left.  A snapshot holds the
whole counts as of a batch and stands for it and all before; a last full read
replaces them the same way.  Reading sums the latest snapshot and the changes
after it, and compact() writes such a snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The facets of a comment that are counted.
FACETS = ("severity", "category", "file_path")


def facet_changes(comments: DataFrame, sign: Column | None = None) -> DataFrame:
    """(facet, value, change) for each facet of each comment; the sign is 1 for a comment that comes and -1 for one that goes."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in FACETS])
    change = F.lit(1) if sign is None else sign
    return comments.select(F.explode(pairs).alias("p"), change.cast("long").alias("change")).select("p.facet", "p.value", "change")


class Counts:
    """Counts by keys in a folder; rows of changes have the keys and ``change``."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("facet", "value")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        summed = rows.groupBy(*self.keys).agg(F.sum("change").alias("change")).where("change <> 0")
        summed.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Write a batch's changes; again gives the same."""
        self._write(changes, "change", batch)

    def replace(self, rows: DataFrame, batch: int) -> None:
        """Whole counts (as changes from nothing), in place of all up to a batch."""
        self._write(rows, "snapshot", batch)

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _rows(self) -> tuple[DataFrame | None, int]:
        """The latest snapshot with all changes after it, and the last batch's number."""
        snapshots, changes = self._read("snapshot"), self._read("change")
        since = None if snapshots is None else snapshots.agg(F.max("batch")).first()[0]
        parts, last = [], -1 if since is None else since
        if since is not None:
            parts.append(snapshots.where(F.col("batch") == since))
        if changes is not None:
            later = changes.where(F.col("batch") > last)
            last = max(last, later.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0])
            parts.append(later)
        rows = None
        for p in parts:
            rows = p if rows is None else rows.unionByName(p)
        return rows, last

    def read(self) -> DataFrame:
        """The keys with n, for counts other than zero."""
        rows, _ = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in self.keys) + ", n long")
        return rows.groupBy(*self.keys).agg(F.sum("change").alias("n")).where("n <> 0")

    def compact(self) -> None:
        """Write the counts so far as a snapshot, so that reading them does not grow with the batches."""
        rows, last = self._rows()
        if rows is not None and last >= 0:
            self.replace(rows.select(*self.keys, "change"), last)

    def follow(self, stream: DataFrame, changes: Callable[[DataFrame], DataFrame], checkpoint: str):
        """Apply what ``changes`` makes of each micro-batch; runs to the end of what is there and returns the query."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.apply(changes(rows), batch))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
