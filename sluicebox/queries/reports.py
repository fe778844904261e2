"""Queries over reports, attestations and tree diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diff as D
from ..operators import reports
from ..sources import attestations, derived
from ..streaming import events as E
from . import changes, jobs, reviews

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _place() -> Column:
    """A line item's place in its order; line numbers repeat."""
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))


#: The same in SQL.
_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)"


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A review for each order (every seventh without files), a file for each part in it and a comment for each line item but some."""
    orders, li = derived.table(spark, sf_dir, "orders"), derived.table(spark, sf_dir, "lineitem")
    results = orders.select(F.col("o_orderkey").alias("review"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about "), F.col("o_orderstatus"))).otherwise("").alias("summary"))
    items = li.where("l_orderkey % 7 <> 0")
    of = items.select(F.col("l_orderkey").alias("review"), _place().alias("file_no"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"), F.col("l_linenumber").alias("pos"), "l_quantity", "l_partkey", "l_returnflag", "l_linestatus")
    files = of.select("review", "file_no", "file_path")
    comments = of.where("l_partkey % 4 <> 0").select(
        "review", "file_no", "pos", F.floor("l_quantity").cast("int").alias("line"), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "Warning").otherwise("").alias("severity"),
        F.when(F.col("l_partkey") % 3 == 0, "high").otherwise("").alias("confidence"), F.lit("").alias("type"), F.when(F.col("l_partkey") % 5 == 0, "style").otherwise("").alias("category"),
        F.when(F.col("l_partkey") % 2 == 0, "names").otherwise("").alias("subcategory"), F.concat(F.lit("ship by "), F.col("l_linestatus"), F.lit("\nor not")).alias("content"),
    )
    return results, files, comments


_REVIEWS = f"""
    r AS (SELECT o_orderkey AS review, CASE WHEN o_orderkey % 3 = 0 THEN 'about ' || o_orderstatus ELSE '' END AS summary FROM orders),
    i AS (SELECT *, CAST(floor(l_quantity) AS INTEGER) AS line, {_PLACE} AS place FROM lineitem WHERE l_orderkey % 7 <> 0),
    c AS (
        SELECT l_orderkey AS review, place AS file_no, '[' || CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'WARNING' ELSE 'INFO' END || '] Line ' || CAST(line AS VARCHAR) || CASE WHEN l_partkey % 5 = 0 THEN ' (style)' ELSE '' END
            || CASE WHEN l_partkey % 3 = 0 OR l_partkey % 2 = 0 THEN chr(10) || '    Tags:' || CASE WHEN l_partkey % 3 = 0 THEN ' confidence=high' ELSE '' END || CASE WHEN l_partkey % 2 = 0 THEN ' subcategory=names' ELSE '' END ELSE '' END AS head, l_linestatus
        FROM i WHERE l_partkey % 4 <> 0)"""


@query(f"""WITH {_REVIEWS},
    f AS (SELECT i.l_orderkey AS review, i.place AS file_no, chr(10) || repeat('-', 80) || chr(10) || 'FILE: f' || CAST(l_partkey AS VARCHAR) || chr(10) || repeat('-', 80) || chr(10)
            || coalesce(chr(10) || '  ' || c.head || chr(10) || '    ship by ' || c.l_linestatus || chr(10) || '    or not' || chr(10), '  No comments for this file.' || chr(10)) AS text
        FROM i LEFT JOIN c ON c.review = i.l_orderkey AND c.file_no = i.place),
    b AS (SELECT review, string_agg(text, '' ORDER BY file_no) AS body, count(*) AS n FROM f GROUP BY review), k AS (SELECT review, count(*) AS n FROM c GROUP BY review)
    SELECT r.review, chr(10) || repeat('=', 80) || chr(10) || 'RESULTS' || chr(10) || repeat('=', 80) || chr(10) || CASE WHEN summary <> '' THEN chr(10) || 'Summary:' || chr(10) || summary || chr(10) ELSE '' END
        || CASE WHEN b.n IS NULL THEN chr(10) || 'No files reviewed or no comments generated.' || chr(10) ELSE chr(10) || CAST(b.n AS VARCHAR) || ' file(s) with comments:' || chr(10) || body || chr(10) || repeat('=', 80) || chr(10) || 'Review complete: ' || CAST(coalesce(k.n, 0) AS VARCHAR) || ' total comment(s)' || chr(10) || repeat('=', 80) || chr(10) || chr(10) END AS text
    FROM r LEFT JOIN b ON b.review = r.review LEFT JOIN k ON k.review = r.review""")
def report_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pretty(*_reviews(spark, sf_dir), "RESULTS")


def report_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each document's diff, with a comment on every fourth added line (tests hold it against a plain version)."""
    lines = D.diff_lines(changes.document_diffs(spark, sf_dir), "doc_id", "diff").withColumnRenamed("doc_id", "review").withColumn("file_no", F.lit(1))
    docs = derived.table(spark, sf_dir, "documents")
    results = docs.select(F.col("doc_id").alias("review"), F.coalesce("source", F.lit("")).alias("summary"))
    files = docs.select(F.col("doc_id").alias("review"), F.lit(1).alias("file_no"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"))
    some = lines.where("kind = 'add' and new_line % 4 = 0")
    comments = some.select("review", "file_no", F.col("new_line").alias("pos"), F.col("new_line").alias("line"), F.lit("warning").alias("severity"), F.lit("").alias("confidence"), F.lit("bug").alias("type"), F.lit("").alias("category"), F.lit("").alias("subcategory"), F.substring("content", 1, 9).alias("content"))
    return reports.with_comments(results, files, lines, comments, "RESULTS", "2026-01-01T00:00:00Z")


QUERIES["report_with_comments"] = report_with_comments


@query(f"""WITH {_REVIEWS},
    j AS (SELECT l_orderkey AS review, place AS file_no, '{{"file_path":"f' || CAST(l_partkey AS VARCHAR) || '","comments":[' || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '{{"line":' || CAST(line AS VARCHAR) || ',"content":"ship by ' || l_linestatus || '\\nor not","severity":"' || CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'Warning' ELSE '' END
        || '","confidence":"' || CASE WHEN l_partkey % 3 = 0 THEN 'high' ELSE '' END || '","type":"","category":"' || CASE WHEN l_partkey % 5 = 0 THEN 'style' ELSE '' END || '","subcategory":"' || CASE WHEN l_partkey % 2 = 0 THEN 'names' ELSE '' END || '"}}' END || ']}}' AS t FROM i)
    SELECT r.review, '{{"summary":"' || summary || '"' || coalesce(',"files":[' || string_agg(t, ',' ORDER BY file_no) || ']', '') || '}}' AS json FROM r LEFT JOIN j ON j.review = r.review GROUP BY r.review, summary""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_json(*_reviews(spark, sf_dir))


@query("""WITH u AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'free_30k' WHEN c_custkey % 4 = 1 THEN 'team_32usd' WHEN c_custkey % 4 = 2 THEN 'loc_200k' ELSE '' END AS p FROM customer)
    SELECT k AS customer, array_to_string(list_filter([CASE WHEN p <> '' THEN 'plan_code: ' || p END, CASE p WHEN 'free_30k' THEN 'ai_mode: BYOK required on free plan' WHEN 'team_32usd' THEN 'ai_mode: Auto by default on team plan (BYOK optional)' END,
        CASE WHEN k % 3 <> 0 THEN 'usage_percent: ' || CAST(k % 101 AS VARCHAR) || '%' END, CASE WHEN k % 5 <> 0 THEN 'loc_used/limit/remaining: ' || CAST(k AS VARCHAR) || '/?/' || CASE WHEN k % 2 = 0 THEN CAST(k * 2 AS VARCHAR) ELSE '?' END END,
        CASE WHEN k % 6 = 0 THEN 'reset_at: 2026-02-01' END, CASE WHEN k % 7 = 0 THEN 'blocked: true' END], lambda x: x IS NOT NULL), chr(10)) AS lines FROM u""")
def usage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("customer")
    none = F.lit(None)
    c = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    rows = c.withColumns({
        "plan_code": F.when(k % 4 == 0, "free_30k").when(k % 4 == 1, "team_32usd").when(k % 4 == 2, "loc_200k").otherwise(""), "usage_percent": F.when(k % 3 != 0, k % 101), "loc_used": F.when(k % 5 != 0, k), "loc_limit": none.cast("long"),
        "loc_remain": F.when((k % 5 != 0) & (k % 2 == 0), k * 2), "reset_at": F.when(k % 6 == 0, "2026-02-01"), "threshold_state": F.lit(""), "trial_readonly": none.cast("boolean"), "blocked": k % 7 == 0, "billable_loc": none.cast("long"),
        "operation_type": F.lit(""), "execution_mode": none.cast("string"), "execution_source": F.lit(""),
    })
    return rows.select("customer", F.array_join(reports.usage_lines(), "\n").alias("lines"))


@query(f"""WITH x AS (SELECT l_orderkey AS review, {_PLACE} AS ord, 'f' || CAST(l_partkey % 50 AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ' — ' || l_linestatus || CASE WHEN l_returnflag <> 'N' THEN ' (' || l_returnflag || CASE WHEN l_partkey % 2 = 0 THEN ', ' || l_linestatus ELSE '' END || ')' ELSE '' END AS t FROM lineitem),
    n AS (SELECT review, ord, CAST(row_number() OVER (PARTITION BY review ORDER BY ord) AS VARCHAR) || '. ' || t AS t FROM x) SELECT review, string_agg(t, chr(10) || chr(10) ORDER BY ord) AS text FROM n GROUP BY review""")
def issue_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("review"), _place().alias("ord"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file_path"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("content"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("severity"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("category"))
    return reports.issue_list(rows, "review")


@query("""WITH e AS (SELECT user_id AS review, event_id, ts, CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'batch' WHEN 'signup' THEN 'status' WHEN 'error' THEN 'completion' ELSE 'artifact' END AS type FROM events),
    m AS (SELECT *, CASE type WHEN 'log' THEN '' WHEN 'batch' THEN 'Batch b completed: generated 0 comments' WHEN 'status' THEN CASE WHEN event_id % 2 = 0 THEN 'Status: running' ELSE 'Status: unknown' END WHEN 'completion' THEN 'Process completed with 0 comments' ELSE 'Artifact: unknown' END AS message FROM e),
    n AS (SELECT review, event_id, '[' || CAST(row_number() OVER (PARTITION BY review ORDER BY event_id) AS VARCHAR) || '] ' || strftime(ts, '%H:%M:%S') || ' - ' || upper(type) || chr(10) || '  ' || message AS t FROM m)
    SELECT review, string_agg(t, chr(10) || chr(10) ORDER BY event_id) AS text FROM n GROUP BY review""")
def event_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.event_log(E.message(reviews.review_events(spark, sf_dir)), "review")


@query(f"""WITH o AS ({jobs.ORACLES['osv_flatten']}),
    t AS (SELECT 18 AS part, go_id, '| ' || go_id || ' | ' || CASE cve WHEN '' THEN '-' ELSE cve END || ' | ' || called || ' | ' || replace(summary, '|', '\\|') || ' | ' || replace(fixed, '|', '\\|') || ' | ' || disposition || ' | ' || fix_track || ' |' AS line FROM o),
    n AS (SELECT unnest(['Total vulnerabilities', 'Called true', 'Called false', 'Called unknown']) AS label, unnest([4, 5, 6, 7]) AS part, unnest(['', 'true', 'false', 'unknown']) AS called),
    h AS (SELECT unnest([0, 1, 2, 3, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]) AS part, unnest(['# OSV Triage Matrix', '', 'Source report: `parts`', '', '', '## Initial Disposition Rules', '', '- `actionable-now`: scanner marked called=true; treat as reachable until disproven.',
        '- `verify-reachability`: scanner marked called=false; confirm by code-path review.', '', '## Vulnerability Table', '', '| GO ID | CVE | Called | Summary | Fixed Versions | Disposition | Fix Track |', '|---|---|---|---|---|---|---|']) AS line)
    SELECT part, '' AS go_id, line FROM h UNION ALL SELECT part, '', '- ' || label || ': ' || CAST((SELECT count(*) FROM o WHERE n.called = '' OR o.called = n.called) AS VARCHAR) FROM n UNION ALL SELECT part, go_id, line FROM t""")
def osv_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.osv_markdown(jobs.osv_flatten(spark, sf_dir), "parts")


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS top FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS customer, CASE WHEN top IS NULL OR top % 5 = 0 OR top % 7 = 0 THEN '' ELSE o_orderstatus END AS action FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN orders ON o_orderkey = top""")
def attestation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest attestation's action for each customer's tree: one is written for each order, some are removed, some malformed."""
    orders, customer = derived.table(spark, sf_dir, "orders"), derived.table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    payload = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, "{bad").otherwise(F.to_json(F.struct(F.concat(F.lit(" "), "o_orderstatus").alias("action"))))
    written = orders.select(F.col("o_custkey").cast("string").alias("tree_hash"), F.lit(0).cast("timestamp").alias("written_at"), k.alias("seq"), payload.alias("payload"))
    latest = attestations.latest(written)
    return attestations.actions_of(customer.select(F.col("c_custkey").cast("string").alias("tree_hash"), F.col("c_custkey").alias("customer")), latest).select("customer", "action")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS tree2, 'f' || CAST(l_partkey AS VARCHAR) AS file_path, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(floor(l_quantity) AS INTEGER) % 10 - 1 AS "end" FROM lineitem WHERE CAST(floor(l_quantity) AS INTEGER) % 10 > 0""")
def tree_diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges from the text of a diff between two trees for each order: a file and a hunk for each line item."""
    li = derived.table(spark, sf_dir, "lineitem")
    path, n = F.concat(F.lit("f"), F.col("l_partkey").cast("string")), F.floor("l_quantity").cast("int") % 10
    count = F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string")))
    section = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n@@ -1 +"), (F.col("l_linenumber") * 10).cast("string"), count, F.lit(" @@ head\n+x\n"))
    diffs = li.groupBy(F.col("l_orderkey").cast("string").alias("tree2")).agg(F.array_join(F.array_sort(F.collect_list(section)), "").alias("diff")).withColumn("tree1", F.lit("before"))
    return D.changed_ranges(diffs).select("tree2", "file_path", "start", "end")
