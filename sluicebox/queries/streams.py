"""Queries that run as streams to the end of what is there, stopped and started again on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import derived
from ..sources.scratch import folder
from ..streaming import events, registers, source, views
from . import reviews

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _append(rows: DataFrame, path: str) -> None:
    """Append to a folder, with times whose statistics Parquet keeps."""
    conf, key = rows.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    before = conf.get(key)
    conf.set(key, "TIMESTAMP_MICROS")
    try:
        rows.write.mode("append").parquet(path)
    finally:
        conf.set(key, before)


def _to_the_end(make: Callable[[], DataFrame], parts: list[DataFrame], path: str) -> DataFrame:
    """What a stream over a folder gives when it is run after each part is appended, from its checkpoint on."""
    spark = parts[0].sparkSession
    out, checkpoint = folder(spark), folder(spark)
    for part in parts:
        _append(part, path)
        writer = make().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {reviews.EVENTS} SELECT type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY type")
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events followed from a log that grows by half, each once although batches overlap."""
    spark.dataSource.register(source.ReviewEvents)
    path = folder(spark)
    rows = reviews.review_events(spark, sf_dir).withColumn("id", F.col("seq").cast("string"))
    first = F.col("time") < "2024-01-15"
    found = _to_the_end(lambda: events.deduplicate(spark.readStream.format("review_events").load(path), "10 seconds"), [rows.where(first), rows.where(~first)], path)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(reviews.ORACLES["draft_register"])
def stream_draft_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drafts of draft_register as a stream that is stopped in the middle of each draft."""
    c = derived.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 6 == 5, "freeze").otherwise("update").alias("kind"), F.col("text"), (F.col("turn") % 3).alias("expected"))
    path = folder(spark)
    read = lambda: registers.draft_updates(spark.readStream.schema(rows.schema).parquet(path))
    return _to_the_end(read, [rows.where("seq <= 2"), rows.where("seq > 2")], path)


@query(f"""WITH {reviews.EVENTS}, c AS (SELECT 'f' || CAST(seq % 50 AS VARCHAR) AS file_path, CASE WHEN seq % 3 = 0 THEN 'critical' ELSE 'info' END AS severity, 'review' AS category FROM e WHERE type = 'batch' AND seq % 5 <> 0 AND seq % 40 > 0)
    SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM c GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category UNION ALL SELECT 'file_path', file_path, count(*) FROM c GROUP BY file_path""")
def maintained_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts kept up by the batches of an event stream, some of them compacted on the way."""
    path, view, checkpoint = folder(spark), views.Counts(spark, folder(spark)), folder(spark)
    rows = reviews.review_events(spark, sf_dir).withColumn("id", F.col("seq").cast("string"))
    for part in range(2):
        _append(rows.where(F.col("seq") % 2 == part), path)
        view.follow(spark.readStream.schema(rows.schema).parquet(path), lambda batch: views.facet_changes(events.comments(batch)), checkpoint).awaitTermination()
        if not part:
            view.compact()
    return view.read()
