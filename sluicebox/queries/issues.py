"""Queries over issue facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import comments as C
from ..operators import facets
from ..sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: What the queries' filters take away.
DISABLED = {"severity": ["info"], "type": ["ECONOMY BRASS"], "category": ["Brand#11", "brand#12"], "subcategory": ["size3"]}

COMMENTS = """
    comments AS (
        SELECT 'f' || CAST(l_partkey % 50 AS VARCHAR) AS file_path, l_linenumber AS line, l_orderkey, l_partkey,
            CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity,
            CASE l_linestatus WHEN 'O' THEN 'High' ELSE 'low' END AS confidence, p_type AS type, p_brand AS category,
            CASE WHEN p_size % 7 = 0 THEN '' ELSE 'Size' || CAST(p_size % 5 AS VARCHAR) END AS subcategory,
            'item ' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS content
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    hidden AS (SELECT *, l_orderkey % 11 = 0 AS is_hidden FROM comments),
    shaped AS (
        SELECT *, lower(severity) = 'info' AS off_sev, lower(type) = 'economy brass' AS off_type, lower(category) IN ('brand#11', 'brand#12') AS off_cat, lower(subcategory) = 'size3' AS off_sub FROM hidden)"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {COMMENTS} {sql}" if sql.lstrip()[0] != "," else f"WITH {COMMENTS}{sql}"
        return f

    return register


def hidden_keys(comments: DataFrame) -> DataFrame:
    """Keys of the comments whose order is a multiple of eleven, as a user might have hidden them."""
    return facets.shaped(comments.where(F.col("ord.l_orderkey") % 11 == 0)).select(facets.visibility_key().alias("key")).distinct()


@query(""", long AS (
        SELECT 'severity' AS facet, severity AS value, severity AS raw, NOT off_type AND NOT off_cat AND NOT off_sub AS ok, l_orderkey, line, l_partkey FROM shaped WHERE NOT is_hidden
        UNION ALL SELECT 'confidence', lower(confidence), confidence, NOT off_sev AND NOT off_type AND NOT off_cat AND NOT off_sub, l_orderkey, line, l_partkey FROM shaped WHERE NOT is_hidden
        UNION ALL SELECT 'type', lower(type), type, NOT off_sev AND NOT off_cat AND NOT off_sub, l_orderkey, line, l_partkey FROM shaped WHERE NOT is_hidden
        UNION ALL SELECT 'category', lower(category), category, NOT off_sev AND NOT off_type AND NOT off_sub, l_orderkey, line, l_partkey FROM shaped WHERE NOT is_hidden
        UNION ALL SELECT 'subcategory', lower(subcategory), subcategory, NOT off_sev AND NOT off_type AND NOT off_cat, l_orderkey, line, l_partkey FROM shaped WHERE NOT is_hidden),
    counted AS (SELECT facet, value, count(*) AS n, min(raw) AS raw FROM long WHERE ok AND value <> '' GROUP BY facet, value),
    everything AS (SELECT facet, value, n, raw FROM counted UNION ALL SELECT 'severity', s, 0, s FROM (VALUES ('critical'), ('warning'), ('info')) t(s) WHERE s NOT IN (SELECT value FROM counted WHERE facet = 'severity'))
    SELECT facet, value, CASE WHEN facet = 'severity' THEN upper(substr(value, 1, 1)) || substr(value, 2) ELSE raw END AS label, CAST(n AS BIGINT) AS count,
        NOT ((facet = 'severity' AND value = 'info') OR (facet = 'type' AND value = 'economy brass') OR (facet = 'category' AND value IN ('brand#11', 'brand#12')) OR (facet = 'subcategory' AND value = 'size3')) AS active
    FROM everything""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.facet_counts(rows, DISABLED, hidden_keys(rows))


@query("""SELECT s.value, s.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM (SELECT lower(subcategory) AS value, min(subcategory) AS label FROM shaped WHERE NOT is_hidden AND NOT off_cat AND subcategory <> '' GROUP BY lower(subcategory)) s
    LEFT JOIN (SELECT lower(subcategory) AS value, count(*) AS n FROM shaped WHERE NOT is_hidden AND NOT off_sev AND NOT off_type AND NOT off_cat AND subcategory <> '' GROUP BY lower(subcategory)) c ON c.value = s.value""")
def facet_subcategory_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.scoped_subcategories(rows, DISABLED, hidden_keys(rows))


@query("""SELECT lower(category) AS category, lower(subcategory) AS subcategory, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY lower(category)) AS BIGINT) AS category_n,
        lower(category) NOT IN ('brand#11', 'brand#12') AND lower(subcategory) <> 'size3' AS active
    FROM shaped WHERE NOT is_hidden AND NOT off_sev AND NOT off_type GROUP BY lower(category), lower(subcategory) HAVING lower(subcategory) <> ''
    UNION ALL SELECT lower(category), '', count(*), count(*), lower(category) NOT IN ('brand#11', 'brand#12') FROM shaped WHERE false GROUP BY lower(category)""")
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    tree = facets.category_tree(rows, DISABLED, hidden_keys(rows))
    flat = tree.select(F.col("value").alias("category"), F.explode("subcategories").alias("s"))
    flat = flat.select("category", F.col("s.value").alias("subcategory"), F.col("s.count").alias("n"), F.col("s.active").alias("active"))
    return flat.withColumn("category_n", F.sum("n").over(Window.partitionBy("category")))


@query("""SELECT lower(category) AS value, min(category) AS label, count(*) AS count, lower(category) NOT IN ('brand#11', 'brand#12') AS active, count(DISTINCT nullif(lower(subcategory), '')) AS n_sub
    FROM shaped WHERE NOT is_hidden AND NOT off_sev AND NOT off_type GROUP BY lower(category)""")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.category_tree(rows, DISABLED, hidden_keys(rows)).select("value", "label", "count", "active", F.size("subcategories").cast("long").alias("n_sub"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_hidden AND NOT off_sev AND NOT off_type AND NOT off_cat AND NOT off_sub) AS visible, count(*) FILTER (WHERE severity = 'critical') AS critical,
    count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM shaped""")
def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.issue_counts(rows, DISABLED, hidden_keys(rows))


@query("SELECT file_path, count(*) FILTER (WHERE NOT is_hidden AND NOT off_sev AND NOT off_type AND NOT off_cat AND NOT off_sub) AS visible FROM shaped GROUP BY file_path")
def file_visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.file_counts(rows, DISABLED, hidden_keys(rows))


@query("SELECT category, count(*) AS count, count(DISTINCT CASE WHEN subcategory <> '' AND NOT off_cat THEN subcategory END) AS subcategories FROM shaped WHERE NOT is_hidden GROUP BY category")
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.filter_stats(rows, DISABLED, hidden_keys(rows))


@query("""SELECT facet, string_agg(DISTINCT value, ',' ORDER BY value) AS items FROM (
        SELECT 'confidence' AS facet, lower(confidence) AS value FROM shaped WHERE NOT is_hidden UNION ALL SELECT 'type', lower(type) FROM shaped WHERE NOT is_hidden
        UNION ALL SELECT 'category', lower(category) FROM shaped WHERE NOT is_hidden UNION ALL SELECT 'subcategory', lower(subcategory) FROM shaped WHERE NOT is_hidden) t
    WHERE value <> '' GROUP BY facet""")
def facet_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.universe(rows, hidden_keys(rows)).select("facet", F.array_join("items", ",").alias("items"))


@query("""SELECT 'type' AS facet, CAST(count(DISTINCT CASE WHEN NOT off_type THEN lower(type) END) AS INTEGER) AS enabled FROM shaped WHERE NOT is_hidden
    UNION ALL SELECT 'category', CAST(count(DISTINCT CASE WHEN NOT off_cat THEN lower(category) END) AS INTEGER) FROM shaped WHERE NOT is_hidden
    UNION ALL SELECT 'subcategory', CAST(count(DISTINCT CASE WHEN NOT off_sub AND subcategory <> '' THEN lower(subcategory) END) AS INTEGER) FROM shaped WHERE NOT is_hidden""")
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.comments(spark, sf_dir)
    return facets.summary(facets.universe(rows, hidden_keys(rows)), DISABLED)


@query("SELECT 'severity' AS kind, severity AS value, count(*) AS count FROM comments GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM comments GROUP BY type")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.impact(derived.comments(spark, sf_dir))


@query("SELECT file_path, count(*) AS n, min(line) AS first_line FROM shaped WHERE NOT off_sev AND NOT off_type AND NOT off_cat AND NOT off_sub GROUP BY file_path")
def files_with_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facets.keep_visible(derived.comments(spark, sf_dir), DISABLED)
    return rows.select("file_path", F.size("comments").cast("long").alias("n"), F.array_min("comments.line").alias("first_line"))


@query("SELECT content, 'comment-' || file_path || '-' || CAST(line AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY file_path, line ORDER BY l_orderkey, l_partkey) - 1 AS VARCHAR) AS comment_id FROM comments")
def comment_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ordinals(derived.comments(spark, sf_dir)).select("content", "comment_id")


@query("""SELECT content, coalesce(lead(content) OVER w, first_value(content) OVER w) AS next_content, coalesce(lag(content) OVER w, last_value(content) OVER v) AS prev_content FROM comments
    WINDOW w AS (PARTITION BY file_path ORDER BY l_orderkey, line, l_partkey), v AS (PARTITION BY file_path ORDER BY l_orderkey, line, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def comment_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.neighbours(derived.comments(spark, sf_dir)).select("content", "next_content", "prev_content")


@query(""", want AS (SELECT DISTINCT 'F' || CAST(p_partkey AS VARCHAR) || '.go' AS path FROM part), files AS (SELECT 'dir' || CAST(p_size % 3 AS VARCHAR) || '/f' || CAST(p_partkey % 1500 AS VARCHAR) || '.go' AS file_path FROM part GROUP BY ALL)
    SELECT path, CASE WHEN count(file_path) = 1 THEN min(file_path) END AS file_path FROM want LEFT JOIN files ON lower(file_path) LIKE '%/' || lower(path) GROUP BY path""")
def slide_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    want = part.select(F.concat(F.lit("F"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path")).distinct()
    files = part.select(F.concat(F.lit("dir"), (F.col("p_size") % 3).cast("string"), F.lit("/f"), (F.col("p_partkey") % 1500).cast("string"), F.lit(".go")).alias("file_path")).distinct()
    return C.unique_suffix(want, files)
