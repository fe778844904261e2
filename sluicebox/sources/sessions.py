"""The store of review sessions: a Parquet table to append to, read and clean up."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage

SCHEMA = "id bigint, tree_hash string, branch string, action string, timestamp string, diff_files string, review_id string"


class SessionStore:
    """Sessions under a folder, partitioned by branch, so that a branch's cleanup touches that branch alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame) -> None:
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).write.mode("append").partitionBy("branch").parquet(self.path)

    def count(self, branch: str) -> int:
        return self.read().where(F.col("branch") == branch).count()

    def reviewed(self, branch: str) -> DataFrame:
        """Reviewed sessions of a branch by time (as text)."""
        return self.read().where((F.col("branch") == branch) & (F.col("action") == "reviewed")).orderBy("timestamp", "id")

    def delete_branch(self, branch: str, dry_run: bool = False) -> int:
        """Delete a branch's sessions; how many there were."""
        n = self.count(branch)
        if n and not dry_run:
            self._overwrite(branch)
        return n

    def delete_all(self, confirmed: bool = False) -> int:
        """Delete all sessions, if confirmed; how many there were."""
        if not confirmed:
            raise ValueError("deleting all sessions has to be confirmed")
        n = self.read().count()
        if n:
            self.read().limit(0).write.mode("overwrite").parquet(self.path)
        return n

    def _overwrite(self, branch: str) -> None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/branch={branch}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def record(self, session: DataFrame, tree_changes: DataFrame, changed_ranges: DataFrame) -> DataFrame:
        """Coverage of new sessions by the ones before them, written under the store's own folder of results; the new ones are stored after that."""
        path = f"{self.path.rstrip('/')}-coverage/{uuid.uuid4().hex}"
        coverage.prior_coverage(self.read(), session, tree_changes, changed_ranges).write.parquet(path)
        self.append(session)
        return self.spark.read.parquet(path)
