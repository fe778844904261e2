"""Queries with SQLite's dates, JSON functions, collation and bare columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqlite as S
from ..sources import derived
from .history import LOG

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


#: The events' properties within a larger document; each thirteenth is malformed, each seventh has no list.
_DOCS = """WITH j AS (SELECT event_id, event_type, CASE WHEN event_id % 13 = 0 THEN '{"bad": ' WHEN event_id % 7 = 0 THEN '{"props": ' || props || '}'
    ELSE '{"props": ' || props || ', "n": {"a": [' || CAST(event_id % 5 AS VARCHAR) || ', {"b": "' || event_type || ' \\"q\\""}, null], "t": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}, "x.y": "é"}' END AS doc FROM events),
    v AS (SELECT event_id, event_type, CASE WHEN json_valid(doc) THEN doc END AS d FROM j)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, lit = F.col("event_id"), F.lit
    whole = F.concat(lit('{"props": '), F.col("props"), lit(', "n": {"a": ['), (id_ % 5).cast("string"), lit(', {"b": "'), F.col("event_type"), lit(' \\"q\\""}, null], "t": '), F.when(id_ % 2 == 0, "true").otherwise("false"), lit('}, "x.y": "é"}'))
    doc = F.when(id_ % 13 == 0, '{"bad": ').when(id_ % 7 == 0, F.concat(lit('{"props": '), F.col("props"), lit("}"))).otherwise(whole)
    return derived.table(spark, sf_dir, "events").select("event_id", "event_type", doc.alias("doc"))


@query(_DOCS + """ SELECT event_id, json_extract_string(d, '$.props.k') AS k, json_extract_string(d, '$.n.a[1].b') AS b, CASE json_extract_string(d, '$.n.t') WHEN 'true' THEN '1' WHEN 'false' THEN '0' END AS flag,
    json_extract_string(d, '$."x.y"') AS dotted, CAST(json_extract(d, '$.n.a[0]') AS VARCHAR) AS first_json, CASE json_type(d, '$.n.a') WHEN 'ARRAY' THEN 'array' END AS kind,
    CASE WHEN d IS NULL THEN 0 ELSE 1 END AS valid, '{"id":' || CAST(event_id AS VARCHAR) || ',"none":null}' AS made FROM v""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    return _documents(spark, sf_dir).select(
        "event_id",
        S.json_extract(doc, "$.props.k").alias("k"),
        S.json_extract(doc, "$.n.a[1].b").alias("b"),
        S.json_extract(doc, "$.n.t").alias("flag"),
        S.json_extract(doc, "x.y").alias("dotted"),
        S.json_arrow(doc, "$.n.a[0]").alias("first_json"),
        S.json_type(doc, "$.n.a").alias("kind"),
        S.json_valid(doc).alias("valid"),
        S.json_object(id=F.col("event_id"), none=F.lit(None).cast("string")).alias("made"),
    )


@query(_DOCS + """, e AS (SELECT event_type, unnest(range(0, 3)) AS i, d FROM v WHERE json_type(d, '$.n.a') = 'ARRAY')
    SELECT event_type, CAST(i AS VARCHAR) AS key, CASE i WHEN 0 THEN 'integer' WHEN 1 THEN 'object' ELSE 'null' END AS type, count(*) AS n, CAST(sum(CASE WHEN i = 0 THEN CAST(json_extract_string(d, '$.n.a[0]') AS BIGINT) END) AS BIGINT) AS total FROM e GROUP BY event_type, i""")
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.json_each(_documents(spark, sf_dir), "doc", "$.n.a")
    number = F.when(F.col("type") == "integer", F.col("value").cast("long"))
    return rows.groupBy("event_type", "key", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


@query(f"""WITH {LOG}, t AS (SELECT hash, CAST(substr(date, 1, 10) || ' ' || substr(date, 12, 8) AS TIMESTAMP) AS t FROM review_log)
    SELECT hash, strftime(last_day(t), '%Y-%m-%d') AS month_end, strftime(date_trunc('day', t) + INTERVAL 13 DAY + to_days(CAST((8 - dayofweek(t + INTERVAL 13 DAY)) % 7 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS monday,
        strftime(make_date(CAST(year(t) AS INTEGER), 2, 1) + to_days(CAST(day(t) - 1 AS INTEGER)), '%Y-%m-%d') AS overflow, strftime(t, '%j') || '/' || strftime(t, '%w') || '/' || strftime(t, '%W') AS parts,
        CAST(epoch(t + INTERVAL 90 MINUTE) AS BIGINT) AS seconds, CAST(epoch(t) AS BIGINT) AS julian_seconds FROM t""")
def date_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("date")
    return derived.review_log(spark, sf_dir).select(
        "hash",
        S.date(d, "start of month", "+1 month", "-1 day").alias("month_end"),
        S.datetime(d, "start of day", "+13 days", "weekday 1").alias("monday"),
        S.date(d, "+1 month").alias("overflow"),
        S.strftime("%j/%w/%W", d).alias("parts"),
        S.unixepoch(d, "+90 minutes").alias("seconds"),
        F.round((S.julianday(d) - 2440587.5) * 86400).cast("long").alias("julian_seconds"),
    )


@query(f"""WITH {LOG}, a AS (SELECT CASE WHEN coverage % 2 = 0 THEN upper(author) ELSE author END AS name, iterations FROM review_log)
    SELECT lower(name) AS who, count(*) AS n, count(DISTINCT lower(name)) AS names, CAST(sum(iterations) AS BIGINT) AS iterations FROM a WHERE lower(name) <> 'dev7' GROUP BY lower(name)""")
def nocase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.review_log(spark, sf_dir)
    name = F.when(F.col("coverage") % 2 == 0, F.upper("author")).otherwise(F.col("author"))
    named = rows.select(S.nocase(name).alias("name"), "iterations").where(F.col("name") != "Dev7")
    grouped = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.sum("iterations").alias("iterations"))
    return grouped.select(F.lower(F.collate("name", "UTF8_BINARY")).alias("who"), "n", "names", "iterations")


@query(f"""WITH {LOG} SELECT author, coverage, hash, date FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY coverage DESC, hash, date) AS k FROM review_log) t WHERE k = 1""")
def bare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT author, max(coverage), hash, date ... GROUP BY author: hash and date are of the row with the maximum."""
    return S.bare(derived.review_log(spark, sf_dir), ["author"], "coverage", ["hash", "date"])
