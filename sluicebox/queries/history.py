"""Queries over review_log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqlite as S
from ..plans import catalog
from ..sources import derived, dumps
from ..sources import history as log
from ..sources.scratch import folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The table as SQL over events: the message is built and then parsed, as in Spark.
LOG = r"""
    made AS (
        SELECT md5(CAST(event_id AS VARCHAR)) AS hash, 'dev' || CAST(user_id % 10 AS VARCHAR) AS author, event_type AS subject,
            substr(CAST(ts AS VARCHAR), 1, 10) || 'T' || substr(CAST(ts AS VARCHAR), 12, 8) || 'Z' AS date,
            CASE event_type
                WHEN 'view' THEN 'Review Pre-Commit Check: ran (iter:' || CAST(event_id % 5 AS VARCHAR) || ', coverage:' || CAST(event_id % 101 AS VARCHAR) || '%)'
                WHEN 'click' THEN 'Review Pre-Commit Check: vouched (iter:' || CAST(event_id % 5 AS VARCHAR) || ', coverage:' || CAST(event_id % 101 AS VARCHAR) || '%)'
                WHEN 'signup' THEN 'Review Pre-Commit Check: skipped' WHEN 'error' THEN 'Review Pre-Commit Check: skipped manually' ELSE '' END AS trailer
        FROM events),
    parsed AS (SELECT *, regexp_extract(trailer, '^[A-Za-z]+ Pre-Commit Check:\s*(.*)$', 1) AS rest FROM made),
    review_log AS (
        SELECT hash, substr(hash, 1, 7) AS short_hash, author, author || '@example.com' AS email, date, 'main' AS branch, subject,
            CASE WHEN rest LIKE 'ran%' THEN 'reviewed' WHEN rest LIKE 'vouched%' THEN 'vouched' WHEN rest LIKE 'skipped%' THEN 'skipped' ELSE 'none' END AS action,
            CAST(coalesce(nullif(regexp_extract(rest, 'iter:(\d+),\s*coverage:(\d+)%', 1), ''), '0') AS BIGINT) AS iterations,
            CAST(coalesce(nullif(regexp_extract(rest, 'iter:(\d+),\s*coverage:(\d+)%', 2), ''), '0') AS BIGINT) AS coverage
        FROM parsed)"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {LOG} {sql}" if sql.lstrip()[0] != "," else f"WITH {LOG}{sql}"
        return f

    return register


@query("SELECT * FROM review_log")
def review_log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.review_log(spark, sf_dir)


@query("SELECT action AS Action, count(*) AS Commits, round(avg(iterations), 1) AS AvgIter, round(avg(coverage), 1) AS AvgCoveragePct FROM review_log GROUP BY action")
def alias_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), "stats")


@query("SELECT author AS Author, count(*) AS Commits, CAST(sum(CASE WHEN action = 'reviewed' THEN 1 ELSE 0 END) AS BIGINT) AS Reviewed FROM review_log GROUP BY author")
def alias_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), "by-author")


@query("SELECT short_hash AS Hash, date AS Date, action AS Action, subject AS Subject FROM review_log ORDER BY date DESC, hash LIMIT 20")
def alias_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), "recent")


@query("SELECT hash, author, action FROM review_log WHERE hash ILIKE 'A1%'")
def hash_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.review_log(spark, sf_dir).where(S.like(F.col("hash"), "A1%")).select("hash", "author", "action")


@query("SELECT author, round(avg(coverage), 1) AS avg_coverage, count(*) AS commits FROM review_log WHERE action = 'reviewed' GROUP BY author HAVING count(*) > 1")
def reviewed_coverage_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), "SELECT author, round(avg(coverage), 1) AS avg_coverage, count(*) AS commits FROM review_log WHERE action = 'reviewed' GROUP BY author HAVING count(*) > 1;")


@query("SELECT action, count(*) AS n, CAST(sum(iterations) AS BIGINT) AS iterations FROM review_log WHERE date >= '2024-01-05T00:00:00Z' AND date <= '2024-01-20T00:00:00Z' GROUP BY action")
def date_bounded_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.bounded(derived.review_log(spark, sf_dir), "2024-01-05", "2024-01-20")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("iterations").alias("iterations"))


@query("SELECT hash, author, iterations FROM review_log WHERE author = 'dev3' AND action = 'vouched'")
def author_action_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.bounded(derived.review_log(spark, sf_dir), author="^dev3 <", action="vouched").select("hash", "author", "iterations")


@query("""SELECT author, count(*) AS n FROM review_log WHERE (iterations = 1 OR coverage > 50) AND NOT (iterations = 1 AND coverage > 50) GROUP BY author""")
def range_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.review_log(spark, sf_dir)
    both = log.in_range(rows, rows.where("iterations = 1"), rows.where("coverage > 50"), symmetric=True)
    return both.groupBy("author").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.author, a.n AS reviewed, coalesce(b.n, 0) AS skipped, (SELECT count(*) FROM review_log) AS everything
    FROM (SELECT author, count(*) AS n FROM review_log WHERE action = 'reviewed' GROUP BY author) a
    LEFT JOIN (SELECT author, count(*) AS n FROM review_log WHERE action = 'skipped' GROUP BY author) b ON a.author = b.author
    WHERE EXISTS (SELECT 1 FROM review_log c WHERE c.author = a.author AND c.coverage > 99)
        AND a.author NOT IN (SELECT author FROM review_log WHERE iterations > 10)""")
def sql_join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(
        derived.review_log(spark, sf_dir),
        """WITH a AS (SELECT author, count(*) AS n FROM review_log WHERE action = 'reviewed' GROUP BY author),
        b AS (SELECT author, count(*) AS n FROM review_log WHERE action = 'skipped' GROUP BY author)
        SELECT a.author, a.n AS reviewed, coalesce(b.n, 0) AS skipped, (SELECT count(*) FROM review_log) AS everything
        FROM a LEFT JOIN b USING (author)
        WHERE EXISTS (SELECT 1 FROM review_log c WHERE c.author = a.author AND c.coverage > 99)
            AND a.author NOT IN (SELECT author FROM review_log WHERE iterations > 10)""",
    )


@query("""SELECT coalesce(a.coverage, b.coverage) AS coverage, coalesce(a.n, 0) AS reviewed, coalesce(b.n, 0) AS vouched
    FROM (SELECT coverage, count(*) AS n FROM review_log WHERE action = 'reviewed' GROUP BY coverage) a
    FULL JOIN (SELECT coverage, count(*) AS n FROM review_log WHERE action = 'vouched' GROUP BY coverage) b ON a.coverage = b.coverage""")
def sql_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.review_log(spark, sf_dir)
    of = lambda action, name: rows.where(F.col("action") == action).groupBy("coverage").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return of("reviewed", "reviewed").join(of("vouched", "vouched"), "coverage", "full").select("coverage", zero("reviewed"), zero("vouched"))


_WINDOWS = """SELECT hash, row_number() OVER w AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS drnk, ntile(4) OVER w AS quarter,
        lag(coverage, 1, -1) OVER w AS before, lead(coverage, 2) OVER w AS after, first_value(hash) OVER w AS first_hash,
        {sum}sum(iterations) OVER (PARTITION BY author ORDER BY date, hash ROWS BETWEEN 2 PRECEDING AND CURRENT ROW){as_} AS recent,
        round(percent_rank() OVER v, 6) AS pct, round(cume_dist() OVER v, 6) AS cume
    FROM review_log WINDOW w AS (PARTITION BY author ORDER BY date, hash), v AS (PARTITION BY author ORDER BY iterations)"""


@query(_WINDOWS.format(sum="CAST(", as_=" AS BIGINT)"))
def sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), _WINDOWS.format(sum="", as_=""))


@query("""SELECT hash, CAST(sum(CASE WHEN action = 'reviewed' THEN 1 ELSE 0 END) OVER (PARTITION BY author ORDER BY drnk RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS near
    FROM (SELECT *, dense_rank() OVER (PARTITION BY author ORDER BY coverage) AS drnk FROM review_log)""")
def sql_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame counted in groups of peers: a range over their dense rank; FILTER inside a window is a CASE."""
    ranked = derived.review_log(spark, sf_dir).withColumn("drnk", F.dense_rank().over(Window.partitionBy("author").orderBy("coverage")))
    frame = Window.partitionBy("author").orderBy("drnk").rangeBetween(-1, 0)
    return ranked.select("hash", F.sum(F.when(F.col("action") == "reviewed", 1).otherwise(0)).over(frame).alias("near"))


@query("""SELECT author, action FROM ((SELECT author, action FROM review_log WHERE coverage > 50 UNION SELECT author, action FROM review_log WHERE iterations = 2)
    INTERSECT SELECT author, action FROM review_log WHERE action <> 'none') EXCEPT SELECT author, action FROM review_log WHERE author = 'dev1'""")
def sql_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.review_log(spark, sf_dir)
    pair = lambda cond: rows.where(cond).select("author", "action")
    return pair("coverage > 50").union(pair("iterations = 2")).distinct().intersect(pair("action <> 'none'")).exceptAll(pair("author = 'dev1'").distinct())


_STEPS = "t(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT n, count(hash) AS commits, max(coverage) AS best FROM t LEFT JOIN review_log ON iterations = n GROUP BY n"


@query(None)
def sql_recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), f"WITH RECURSIVE {_STEPS}")


ORACLES["sql_recursive_cte"] = f"WITH RECURSIVE {LOG}, {_STEPS}"


@query("""SELECT hash, CAST(coverage // 7 AS BIGINT) AS sevenths, CASE WHEN iterations = 0 THEN NULL ELSE CAST(coverage // iterations AS BIGINT) END AS per_iter,
    CASE WHEN author ILIKE 'DEV%' THEN 1 ELSE 0 END AS is_dev, CASE WHEN regexp_matches(hash, '^a[0-9].*$') THEN 1 ELSE 0 END AS globbed,
    substr(hash, 1, 2) AS two, greatest(iterations, coverage, 3) AS top, upper(subject) AS loud, ltrim(hash, '0123456789') AS letters, strftime(CAST(date AS TIMESTAMP), '%Y/%m/%d') AS day
    FROM review_log""")
def dialect_division_like_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return derived.review_log(spark, sf_dir).select(
        "hash",
        S.divide(c("coverage"), F.lit(7)).alias("sevenths"),
        S.divide(c("coverage"), c("iterations")).alias("per_iter"),
        S.truth(S.like(c("author"), "DEV%")).cast("int").alias("is_dev"),
        S.truth(S.glob(c("hash"), "a[0-9]*")).cast("int").alias("globbed"),
        S.substr(c("hash"), 0, 3).alias("two"),
        S.greatest(c("iterations"), c("coverage"), F.lit(3)).alias("top"),
        S.ascii_upper(c("subject")).alias("loud"),
        S.strip_chars(c("hash"), "0123456789", "left").alias("letters"),
        S.strftime("%Y/%m/%d", c("date")).alias("day"),
    )


@query("""SELECT action, CAST(coalesce(sum(CASE WHEN iterations > 1 THEN coverage END), 0) AS DOUBLE) AS total, count(DISTINCT author) AS authors, CAST(sum(DISTINCT iterations) AS BIGINT) AS distinct_iterations,
    count(*) FILTER (WHERE coverage > 90) AS high, string_agg(DISTINCT author, ',' ORDER BY author) AS names, max(coverage) AS best, arg_min(hash, date || hash) AS earliest FROM review_log GROUP BY action""")
def sql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.review_log(spark, sf_dir)
    return rows.groupBy("action").agg(
        S.total(F.when(F.col("iterations") > 1, F.col("coverage"))).alias("total"),
        F.count_distinct("author").alias("authors"),
        F.sum_distinct("iterations").alias("distinct_iterations"),
        F.count_if(F.col("coverage") > 90).alias("high"),
        F.array_join(F.array_sort(F.collect_set("author")), ",").alias("names"),
        F.max("coverage").alias("best"),
        F.min_by("hash", F.concat("date", "hash")).alias("earliest"),
    )


@query("SELECT count(*) AS n, CAST(sum(coverage) AS BIGINT) AS s, avg(coverage) AS a FROM review_log WHERE author = 'nobody'")
def sql_empty_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(derived.review_log(spark, sf_dir), "SELECT count(*) AS n, sum(coverage) AS s, avg(coverage) AS a FROM review_log WHERE author = 'nobody'")


@query("""SELECT author, action, coverage FROM (SELECT author, action, coverage, hash FROM review_log ORDER BY coverage DESC NULLS LAST, hash LIMIT 15 OFFSET 5)""")
def sql_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.review_log(spark, sf_dir).orderBy(F.desc_nulls_last("coverage"), "hash").offset(5).limit(15).select("author", "action", "coverage")


@query("SELECT branch, author, count(*) AS n FROM review_log WHERE date >= '2024-01-15T00:00:00Z' GROUP BY branch, author")
def relative_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log.since_relative(derived.review_log(spark, sf_dir), "2 weeks ago", F.to_timestamp(F.lit("2024-01-29T00:00:00Z")))
    return rows.groupBy("branch", "author").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'stats' AS name, 'built-in' AS source, count(DISTINCT action) AS n_rows FROM review_log UNION ALL SELECT 'by-author', 'built-in', count(DISTINCT author) FROM review_log
    UNION ALL SELECT 'recent', 'built-in', least(20, count(*)) FROM review_log""")
def alias_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named queries with how many rows each gives."""
    log_rows, found, out = derived.review_log(spark, sf_dir), catalog.Catalog(), None
    for name, _, source in found.listing():
        one = catalog.run(log_rows, name, found).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(source).alias("source"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT author, action, count(*) AS n, max(coverage) AS best FROM review_log WHERE date >= '2024-01-10T00:00:00Z' AND date <= '2024-01-20T00:00:00Z' AND author IN ('dev1', 'dev4') GROUP BY author, action")
def dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as dumps, and read by byte ranges with bounds, an author pattern and an index that skips ranges."""
    path, statistics = folder(spark), folder(spark)
    derived.raw_log(spark, sf_dir).write.option("lineSep", log.RECORD).text(path)
    dumps.index(spark, path, derived.TOOL, statistics)
    rows = dumps.read(spark, path, derived.TOOL, index=statistics, author="^dev[14] <", **{"from": "2024-01-10", "to": "2024-01-20"})
    return rows.groupBy("author", "action").agg(F.count(F.lit(1)).alias("n"), F.max("coverage").alias("best"))
