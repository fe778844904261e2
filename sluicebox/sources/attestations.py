"""Attestations of trees: what a review came to, by the tree's hash.

A Parquet table to append to; the latest row of a tree counts, and a removal is a
row too, so that writers never rewrite what others have written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

SCHEMA = "tree_hash string, written_at timestamp, seq long, payload string"
PAYLOAD = "action string, iterations int, prior_ai_coverage_pct double, prior_review_count int, files array<struct<file_path:string,hunks:array<struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int>>>>"


def latest(rows: DataFrame) -> DataFrame:
    """tree_hash and payload of each tree's latest row, if that is no removal."""
    last = rows.groupBy("tree_hash").agg(F.max_by(F.struct("payload"), F.struct("written_at", "seq")).alias("last"))
    return last.select("tree_hash", "last.payload").where("payload is not null")


def actions_of(trees: DataFrame, own: DataFrame) -> DataFrame:
    """trees (tree_hash) with the action of their attestation (own: tree_hash, payload); none where there is none or it is malformed."""
    parsed = own.select("tree_hash", F.coalesce(strip(F.from_json("payload", PAYLOAD)["action"]), F.lit("")).alias("action"))
    return trees.join(parsed, "tree_hash", "left").withColumn("action", F.coalesce("action", F.lit("")))


class AttestationStore:
    """Attestations under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def write(self, rows: DataFrame) -> None:
        """Append attestations (tree_hash, payload as JSON text)."""
        made = rows.select("tree_hash", F.current_timestamp().alias("written_at"), F.monotonically_increasing_id().alias("seq"), "payload")
        made.write.mode("append").parquet(self.path)

    def remove(self, trees: DataFrame) -> None:
        """Take away the attestations of trees (tree_hash)."""
        self.write(trees.select("tree_hash", F.lit(None).cast("string").alias("payload")))

    def read(self) -> DataFrame:
        """tree_hash and payload of each tree that has an attestation."""
        return latest(self._rows())

    def actions(self, trees: DataFrame) -> DataFrame:
        """trees (tree_hash) with the action of their attestation; none for trees without one and for malformed ones."""
        return actions_of(trees, self.read().join(trees.select("tree_hash").distinct(), "tree_hash", "left_semi"))

    def full(self, trees: DataFrame) -> DataFrame:
        """trees (tree_hash) that have an attestation, with its fields; a malformed one is an error."""
        own = self.read().join(trees.select("tree_hash").distinct(), "tree_hash", "left_semi")
        return own.select("tree_hash", checked(F.col("payload")).alias("p")).select("tree_hash", "p.*")


def checked(payload: Column) -> Column:
    """The payload's fields; an error where it is no JSON object."""
    parsed = F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"})
    sound = F.try_parse_json(payload).isNotNull() & F.substring(strip(payload), 1, 1).eqNullSafe(F.lit("{"))
    return F.coalesce(F.when(sound, parsed), F.from_json(F.raise_error(F.concat(F.lit("malformed attestation: "), F.substring(payload, 1, 80))).cast("string"), PAYLOAD))
