"""Queries over sessions, coverage and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diff as D
from ..functions import text as X
from ..operators import comments as C
from ..operators import coverage
from ..sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SESSIONS = """
    sessions AS (
        SELECT o_orderkey AS id, md5(CAST(o_custkey AS VARCHAR)) AS tree_hash, 'b' || CAST(o_custkey % 20 AS VARCHAR) AS branch, o_custkey AS custkey,
            CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'O' THEN 'skipped' ELSE 'vouched' END AS action,
            substr(CAST(o_orderdate AS VARCHAR), 1, 10) || 'T' || substr(CAST(o_orderdate AS VARCHAR), 12, 8) || 'Z' AS timestamp, 'r' || CAST(o_orderkey AS VARCHAR) AS review_id
        FROM orders),
    hunks AS (
        SELECT l_orderkey AS id, 'f' || CAST(l_partkey % 50 AS VARCHAR) AS file_path, l_linenumber * 10 AS start, CAST(floor(l_quantity) AS INTEGER) % 10 AS n FROM lineitem)"""


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{SESSIONS}", SESSIONS)
        return f

    return register


@query("WITH {SESSIONS} SELECT branch, count(*) AS n, CAST(sum(CASE WHEN action = 'reviewed' THEN 1 ELSE 0 END) AS BIGINT) AS reviewed FROM sessions GROUP BY branch")
def sessions_by_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.orders_as_sessions(spark, sf_dir).groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "reviewed").alias("reviewed"))


@query("WITH {SESSIONS} SELECT id, tree_hash, timestamp, review_id, row_number() OVER (ORDER BY timestamp, id) AS place FROM sessions WHERE branch = 'b7' AND action = 'reviewed'")
def reviewed_sessions_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.orders_as_sessions(spark, sf_dir).where("branch = 'b7' and action = 'reviewed'")
    return rows.select("id", "tree_hash", "timestamp", "review_id", F.row_number().over(Window.partitionBy("branch").orderBy("timestamp", "id")).alias("place"))


@query("WITH {SESSIONS} SELECT branch, CAST(sum(CASE WHEN branch = 'b3' THEN 1 ELSE 0 END) AS BIGINT) AS would_delete, CAST(sum(CASE WHEN branch <> 'b3' THEN 1 ELSE 0 END) AS BIGINT) AS would_keep FROM sessions GROUP BY branch")
def session_delete_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.orders_as_sessions(spark, sf_dir).groupBy("branch").agg(F.count_if(F.col("branch") == "b3").alias("would_delete"), F.count_if(F.col("branch") != "b3").alias("would_keep"))


@query("WITH {SESSIONS} SELECT id, CAST(sum(greatest(n, 0)) AS BIGINT) AS total_lines FROM hunks GROUP BY id")
def coverage_total_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.total_lines(coverage.file_hunks(derived.sessions(spark, sf_dir), "id"), "id")


@query("WITH {SESSIONS} SELECT id, file_path, count(DISTINCT line) AS n_lines, min(line) AS first_line FROM (SELECT id, file_path, unnest(range(start, start + n)) AS line FROM hunks WHERE n > 0) GROUP BY id, file_path")
def coverage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.distinct_lines(coverage.file_hunks(derived.sessions(spark, sf_dir), "id"), "id")


@query("""WITH {SESSIONS},
    current AS (SELECT branch, max(id) AS id FROM sessions GROUP BY branch),
    own AS (SELECT s.branch, s.tree_hash AS tree2, s.custkey AS c2, s.id FROM sessions s JOIN current USING (branch, id)),
    prior AS (SELECT s.* FROM sessions s JOIN current c ON s.branch = c.branch AND s.id < c.id),
    places AS (SELECT DISTINCT branch, tree2, c2, file_path, line FROM (SELECT o.branch, o.tree2, o.c2, h.file_path, unnest(range(h.start, h.start + h.n)) AS line FROM own o JOIN hunks h ON h.id = o.id WHERE h.n > 0)),
    total AS (SELECT o.branch, CAST(sum(greatest(h.n, 0)) AS BIGINT) AS total_lines FROM own o JOIN hunks h ON h.id = o.id GROUP BY o.branch),
    reviewed AS (SELECT DISTINCT branch, tree_hash AS tree1, custkey AS c1 FROM prior WHERE action = 'reviewed'),
    looked AS (SELECT DISTINCT p.branch, p.tree_hash AS tree1, h.file_path FROM prior p JOIN hunks h ON h.id = p.id WHERE p.action = 'reviewed'),
    pairs AS (SELECT p.branch, p.file_path, p.line, r.tree1, r.tree1 <> p.tree2 AND (CAST(substr(p.file_path, 2) AS BIGINT) + r.c1 + p.c2) % 3 = 0 AS changed, (r.c1 + p.c2) % 4 AS off FROM places p JOIN reviewed r ON r.branch = p.branch),
    covered AS (
        SELECT DISTINCT a.branch, a.file_path, a.line FROM pairs a LEFT JOIN looked l ON l.branch = a.branch AND l.tree1 = a.tree1 AND l.file_path = a.file_path
        WHERE NOT a.changed OR (l.tree1 IS NOT NULL AND NOT (a.line % 10 BETWEEN a.off AND a.off + 2)))
    SELECT o.branch, o.tree2 AS tree_hash, (SELECT count(*) FROM prior p WHERE p.branch = o.branch) + 1 AS iterations,
        (SELECT count(*) FROM prior p WHERE p.branch = o.branch AND p.action = 'reviewed') AS prior_reviews, coalesce(t.total_lines, 0) AS total_lines,
        coalesce(c.n, 0) AS covered_lines, CASE WHEN coalesce(t.total_lines, 0) = 0 THEN 0.0 ELSE CAST(coalesce(c.n, 0) AS DOUBLE) / t.total_lines * 100 END AS prior_pct
    FROM own o LEFT JOIN total t ON t.branch = o.branch LEFT JOIN (SELECT branch, count(*) AS n FROM covered GROUP BY branch) c ON c.branch = o.branch""")
def coverage_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session of each branch against the ones before it.

    Trees differ in a file by the customers' keys and the file's number; three
    lines of each ten of a changed file are new.
    """
    all_ = derived.sessions(spark, sf_dir)
    newest = all_.groupBy("branch").agg(F.max("id").alias("newest"))
    marked = all_.join(newest, "branch")
    current, prior = marked.where("id = newest").drop("newest"), marked.where("id < newest").drop("newest")
    keys = derived.orders_as_sessions(spark, sf_dir).select("id", F.col("custkey"))
    t2 = current.join(keys, "id").select("branch", F.col("tree_hash").alias("tree2"), F.col("custkey").alias("c2"), "diff_files")
    t1 = prior.join(keys, "id").select("branch", F.col("tree_hash").alias("tree1"), F.col("custkey").alias("c1")).distinct()
    files = coverage.lines(coverage.file_hunks(t2, "branch", "tree2", "c2"), "branch", "tree2", "c2").distinct()
    met = files.select("branch", "tree2", "c2", "file_path", (F.floor(F.col("line") / 10) * 10).cast("int").alias("tens")).distinct().join(t1, "branch")
    met = met.where((F.substring("file_path", 2, 9).cast("long") + F.col("c1") + F.col("c2")) % 3 == 0)
    start = F.col("tens") + ((F.col("c1") + F.col("c2")) % 4).cast("int")
    ranges = met.select("tree1", "tree2", "file_path", start.alias("start"), (start + 2).alias("end")).distinct()
    return coverage.prior_coverage(prior, current, ranges.select("tree1", "tree2", "file_path").distinct(), ranges)


@query("""WITH {SESSIONS}, made AS (SELECT id, action, id % 4 AS it, CAST(id % 997 AS DOUBLE) / 10 AS pct FROM sessions)
    SELECT id, action, CAST(CASE WHEN it > 0 THEN it ELSE 0 END AS BIGINT) AS iterations, CAST(CASE WHEN it > 0 THEN floor(pct + 0.5) ELSE 0 END AS BIGINT) AS coverage FROM made""")
def trailer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailer is written for each session and read again."""
    rows = derived.orders_as_sessions(spark, sf_dir)
    line = X.format_trailer(F.col("action"), F.col("id") % 4, (F.col("id") % 997).cast("double") / 10, derived.TOOL)
    rest = X.trailer_line(line, derived.TOOL)
    return rows.select("id", X.trailer_action(rest).alias("action"), X.trailer_metric(rest, 1).alias("iterations"), X.trailer_metric(rest, 2).alias("coverage"))


def _line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of one hunk for each line item (counts of 1 are left out, as git does)."""
    li = derived.dealt(derived.table(spark, sf_dir, "lineitem"), "l_orderkey")
    n = F.floor("l_quantity").cast("int") % 10
    count = F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string")))
    text = F.concat(F.lit("@@ -"), F.col("l_linenumber").cast("string"), F.lit(" +"), (F.col("l_linenumber") * 10).cast("string"), count, F.lit(" @@ x"))
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("diff"))


@query("""SELECT l_orderkey, l_linenumber AS old_start_line, 1 AS old_line_count, l_linenumber * 10 AS new_start_line, CAST(floor(l_quantity) AS INTEGER) % 10 AS new_line_count, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def diff_hunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_diffs(spark, sf_dir).select("l_orderkey", F.explode(D.hunk_ranges(F.col("diff"))).alias("h")).select("l_orderkey", "h.*")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each document: its lines are context, added or removed in turn (blank lines hold a mark)."""
    docs = derived.table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (i % 3 + 1).cast("int")), F.lit("|"), F.regexp_replace(x, "\r", "")))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n@@ -5,9 +7,9 @@\n"))
    return docs.select("doc_id", F.concat(head, F.array_join(lines, "\n")).alias("diff"))


LINES = """
    cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    each AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut),
    numbered AS (
        SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS file_path, i, CASE (i - 1) % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'del' ELSE 'context' END AS kind,
            CASE WHEN (i - 1) % 3 = 2 THEN '  |' ELSE '|' END || replace(ls[i], chr(13), '') AS content FROM each),
    lines AS (
        SELECT *, CASE WHEN kind <> 'add' THEN 4 + count(*) FILTER (WHERE kind <> 'add') OVER w END AS old_line, CASE WHEN kind <> 'del' THEN 6 + count(*) FILTER (WHERE kind <> 'del') OVER w END AS new_line
        FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


@query(f"WITH {LINES} SELECT doc_id, file_path, kind, CAST(old_line AS INTEGER) AS old_line, CAST(new_line AS INTEGER) AS new_line, content FROM lines")
def diff_lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_lines(document_diffs(spark, sf_dir), "doc_id", "diff").select("doc_id", "file_path", "kind", "old_line", "new_line", "content")


@query(f"WITH {LINES} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS files, max(new_line) AS last_line FROM lines GROUP BY kind")
def diff_kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.diff_lines(document_diffs(spark, sf_dir), "doc_id", "diff")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("files"), F.max("new_line").cast("long").alias("last_line"))


IGNORES = ["build/", "*.lock", "!build/keep.lock", "/notes.txt", "docs/**/draft*"]


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'build/x' WHEN 1 THEN 'build/keep.lock' WHEN 2 THEN 'src/a.lock' WHEN 3 THEN 'notes.txt' WHEN 4 THEN 'sub/notes.txt' ELSE 'docs/a/b/draft' || CAST(p_size AS VARCHAR) END AS path FROM part)
    SELECT p_partkey, path, path LIKE 'build/x' OR path LIKE 'src/%' OR path = 'notes.txt' OR path LIKE 'docs/%' AS ignored FROM p""")
def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    path = F.element_at(F.array(F.lit("build/x"), F.lit("build/keep.lock"), F.lit("src/a.lock"), F.lit("notes.txt"), F.lit("sub/notes.txt"), F.concat(F.lit("docs/a/b/draft"), F.col("p_size").cast("string"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select("p_partkey", path.alias("path")).withColumn("ignored", D.ignored(F.col("path"), IGNORES))


@query("""WITH d AS (SELECT l_orderkey, 'f' || CAST(l_partkey % 50 AS VARCHAR) AS path, l_linenumber AS i FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (WHERE path LIKE 'f1_') AS n_excluded, count(*) FILTER (WHERE path NOT LIKE 'f1_') AS n_kept FROM d GROUP BY l_orderkey""")
def diff_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"))
    section = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n@@ -1 +1 @@\n+x"))
    diffs = derived.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", section.alias("s")))), lambda x: x["s"]), "\n").alias("diff"))
    rows = D.diff_sections(diffs, "l_orderkey", "diff", ["f1?"])
    return rows.select("l_orderkey", F.size("excluded").cast("long").alias("n_excluded"), F.size(F.regexp_extract_all("kept", F.lit("(?m)^(diff --git )"), F.lit(1))).cast("long").alias("n_kept"))


def _doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on document lines: one for each of the first lines of the orders' items."""
    li = derived.table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("d"), (F.col("l_partkey") % 200).cast("string")).alias("file_path"), (F.col("l_linenumber") + 5).alias("line"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("comment_id"))


NOTES = "notes AS (SELECT 'd' || CAST(l_partkey % 200 AS VARCHAR) AS file_path, l_linenumber + 5 AS line, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS comment_id FROM lineitem)"


@query(f"WITH {LINES}, {NOTES} SELECT l.file_path, l.new_line, count(comment_id) AS n, max(comment_id) AS last_id FROM lines l LEFT JOIN notes n ON n.file_path = l.file_path AND n.line = l.new_line WHERE l.kind = 'add' GROUP BY l.file_path, l.new_line")
def comments_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.diff_lines(document_diffs(spark, sf_dir), "doc_id", "diff")
    rows = C.on_added_lines(lines, _doc_comments(spark, sf_dir)).where("kind = 'add'")
    return rows.groupBy("file_path", F.col("new_line").cast("long").alias("new_line")).agg(F.count("comment_id").alias("n"), F.max("comment_id").alias("last_id"))


@query(f"""WITH {LINES}, {NOTES}, spots AS (SELECT file_path, CASE WHEN kind = 'del' THEN old_line ELSE new_line END AS line, i, kind FROM lines),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file_path, line ORDER BY i) AS k FROM spots)
    SELECT comment_id, n.file_path, CAST(n.line AS INTEGER) AS line, r.kind, count(*) AS copies FROM notes n JOIN ranked r ON r.file_path = n.file_path AND r.line = n.line AND r.k = 1 GROUP BY ALL""")
def comments_consume_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.diff_lines(document_diffs(spark, sf_dir), "doc_id", "diff")
    rows = C.consume_once(lines, _doc_comments(spark, sf_dir))
    return rows.groupBy("comment_id", "file_path", "line", "kind").agg(F.count(F.lit(1)).alias("copies"))


@query("""WITH f AS (SELECT 'f' || CAST(p_partkey AS VARCHAR) AS file_path, 'h' || CAST(p_size AS VARCHAR) AS hunks, 'own' AS comments FROM part),
    s AS (SELECT 'f' || CAST(l_partkey AS VARCHAR) AS file_path, arg_min('c' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR), l_orderkey * 100 + l_linenumber) AS newer FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
    SELECT f.file_path, hunks, coalesce(newer, comments) AS comments FROM f LEFT JOIN s ON s.file_path = f.file_path""")
def result_merge_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, li = derived.table(spark, sf_dir, "part"), derived.table(spark, sf_dir, "lineitem")
    files = part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("hunks"), F.lit("own").alias("comments"))
    state = li.where("l_returnflag = 'R'").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_path"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("comments"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return C.merge_state(files, state)
