"""Queries over summaries, stored versions, releases, reports and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batch, slides
from ..sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(r"""SELECT doc_id, CAST(w AS BIGINT) AS words, CAST(least(greatest(floor(3.5 + w / 3.2 + 0.5), 5), 12) AS BIGINT) AS seconds FROM (
    SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS w FROM documents) t""")
def slide_read_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    words = X.word_count(F.col("text"))
    return docs.select("doc_id", words.alias("words"), X.read_seconds(words).alias("seconds"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings put in: the sections that a summary needs, or some of them."""
    docs = derived.table(spark, sf_dir, "documents")
    last = F.when(F.col("doc_id") % 4 == 0, "## Risks\n").when(F.col("doc_id") % 4 == 1, "## Other\n").otherwise("### Impact\n")
    tail = F.when(F.col("doc_id") % 4 == 2, "one two").otherwise("it matters to all users")
    return docs.select("doc_id", F.concat(F.lit("# Summary\n"), F.regexp_replace("text", "#", ""), F.lit("\n## Highlights!\n\nthe first of many points\n"), last, tail).alias("text"))


@query("""SELECT doc_id, total >= 20 AND doc_id % 4 IN (0, 3) AND body >= 3 AS eligible, CASE WHEN total < 20 THEN 'too-short' WHEN doc_id % 4 = 1 THEN 'missing-required-sections' WHEN doc_id % 4 = 2 OR body < 3 THEN 'empty-required-sections' ELSE 'ok' END AS reason FROM (
    SELECT doc_id, body, body + 2 + 2 + 5 + 2 + CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 5 END AS total FROM (
        SELECT doc_id, len(list_filter(regexp_split_to_array(replace(text, '#', ''), '\\s+'), lambda x: x <> '')) AS body FROM documents) a) b""")
def summary_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.eligibility(_summaries(spark, sf_dir))


def summary_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slides of the documents as summaries, with the time that is left from each on."""
    return slides.remaining(slides.slides(_summaries(spark, sf_dir)))


QUERIES["summary_slides"] = summary_slides

_CHAPTERS = """WITH t AS (SELECT conv_id, turn AS n, CASE WHEN role = 'user' THEN 'A' WHEN turn % 3 = 0 THEN 'B' END AS top, role AS title FROM conversations),
    f AS (SELECT *, coalesce(last_value(top IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING), first_value(top IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), first_value(title) OVER (PARTITION BY conv_id ORDER BY n)) AS chapter FROM t),
    g AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER (PARTITION BY conv_id ORDER BY n) THEN 0 ELSE 1 END AS fresh FROM f),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY n) AS island FROM g),
    r AS (SELECT conv_id, CAST(island AS BIGINT) AS island, chapter, min(n) AS start, max(n) AS "end", count(*) AS slide_count FROM i GROUP BY conv_id, island, chapter)"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("n"), F.when(F.col("role") == "user", "A").when(F.col("turn") % 3 == 0, "B").alias("top"), F.col("role").alias("title"))
    return slides.chapters(rows, "conv_id")


@query(_CHAPTERS + ' SELECT conv_id, island, chapter, start, "end", slide_count FROM r')
def chapter_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir).select("conv_id", "island", "chapter", "start", "end", "slide_count")


@query(_CHAPTERS + " SELECT conv_id, island, round(slide_count * 100.0 / sum(slide_count) OVER (PARTITION BY conv_id), 6) AS width_pct, round((start - min(start) OVER (PARTITION BY conv_id)) * 100.0 / sum(slide_count) OVER (PARTITION BY conv_id), 6) AS offset_pct FROM r")
def chapter_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir).select("conv_id", "island", F.round("width_pct", 6).alias("width_pct"), F.round("offset_pct", 6).alias("offset_pct"))


@query("""SELECT conv_id, turn AS n, round(least(greatest((turn - 0.5) * 100.0 / (max(turn) OVER (PARTITION BY conv_id) + 1), 0), 100), 6) AS centre_pct, round(least(turn * 100.0 / (max(turn) OVER (PARTITION BY conv_id) + 1), 100), 6) AS fill_pct FROM conversations""")
def slide_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"))
    return slides.progress(rows, "conv_id").select("conv_id", "n", F.round("centre_pct", 6).alias("centre_pct"), F.round("fill_pct", 6).alias("fill_pct"))


_VERSIONS = """WITH v AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'f' || CAST(o_custkey % 200 AS VARCHAR) END AS name, CASE o_orderstatus WHEN 'F' THEN 'upload' WHEN 'O' THEN 'hide' ELSE 'other' END AS action, epoch_ms(o_orderdate) AS ts FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 97 == 0, "").otherwise(F.concat(F.lit("f"), (F.col("o_custkey") % 200).cast("string")))
    action = F.when(F.col("o_orderstatus") == "F", "upload").when(F.col("o_orderstatus") == "O", "hide").otherwise("other")
    return o.select(F.col("o_orderkey").alias("ord"), name.alias("fileName"), action.alias("action"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("uploadTimestamp"))


@query(_VERSIONS + """ SELECT ord, name AS "fileName", action, ts AS "uploadTimestamp" FROM (SELECT *, row_number() OVER (PARTITION BY name, action ORDER BY ts DESC, ord) AS k FROM v WHERE name <> '') t WHERE action = 'hide' OR (action = 'upload' AND k > 1)""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.retention(versions(spark, sf_dir))


@query(_VERSIONS + """, n AS (SELECT name, count(*) AS c FROM v WHERE name <> '' GROUP BY name)
    SELECT (SELECT count(*) FROM v) AS total_versions, (SELECT count(*) FROM n) AS unique_file_names, (SELECT count(*) FROM n WHERE c > 1) AS multi_version_file_names,
        (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM n WHERE c > 1 ORDER BY name LIMIT 20) s) AS multi_version_samples""")
def version_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.audit(versions(spark, sf_dir))


@query(_VERSIONS + " SELECT action, count(*) AS n FROM v GROUP BY action")
def version_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.actions(versions(spark, sf_dir))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = derived.table(spark, sf_dir, "part"), F.col("p_partkey")
    version = F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (k % 12).cast("string"), F.lit("."), (k % 17).cast("string"))
    return p.select(F.col("p_brand").alias("brand"), version.alias("version"), F.concat(F.lit("os"), (k % 4).cast("string")).alias("platform"), F.concat(F.lit("u"), k.cast("string")).alias("url"), k.alias("ord"))


_ARTIFACTS = "WITH a AS (SELECT p_brand AS brand, p_partkey % 3 AS x, p_partkey % 12 AS y, p_partkey % 17 AS z, 'v' || CAST(p_partkey % 3 AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) || '.' || CAST(p_partkey % 17 AS VARCHAR) AS version, 'os' || CAST(p_partkey % 4 AS VARCHAR) AS platform, p_partkey FROM part)"


@query(_ARTIFACTS + " SELECT brand, arg_max(version, x * 10000 + y * 100 + z) AS latest FROM a GROUP BY brand")
def semver_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.latest(_artifacts(spark, sf_dir), "version", "brand")


@query(_ARTIFACTS + " SELECT version, string_agg(platform || '=' || 'u' || CAST(k AS VARCHAR), ',' ORDER BY platform) AS platforms FROM (SELECT version, platform, max(p_partkey) AS k FROM a GROUP BY version, platform) t GROUP BY version")
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.manifest(_artifacts(spark, sf_dir))
    return rows.select("version", F.array_join(F.transform(F.map_entries("platforms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("platforms"))


def osv_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports (value) made from the parts, twenty in each: reachable ones, unreachable ones and such that nothing is said of."""
    k, text = F.col("p_partkey"), lambda x, c: F.concat(F.lit(x), c.cast("string"))
    event = lambda introduced, fixed: F.struct(introduced.cast("string").alias("introduced"), fixed.cast("string").alias("fixed"))
    none = F.lit(None)
    first = F.struct(F.array(event(F.lit("0"), none), event(none, text("1.", k % 9))).alias("events"))
    second = F.struct(F.array(event(F.lit("2.0"), none)).alias("events"))
    symbols = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    imports = F.when(k % 6 == 0, F.array(F.struct(F.lit("net/http").alias("path"), symbols("Get", "Post").alias("symbols")), F.struct(F.lit("net").alias("path"), symbols().alias("symbols"))))
    affected = F.struct(F.struct(F.when(k % 5 == 0, "").otherwise(text("x/", k % 7)).alias("name")).alias("package"), F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("ranges"), F.struct(imports.alias("imports")).alias("ecosystem_specific"))
    aliases = F.when(k % 2 == 0, F.array(text("GHSA-", k), text("CVE-", k))).otherwise(F.array().cast("array<string>"))
    vulnerability = F.struct(text("GO-", k).alias("id"), aliases.alias("aliases"), F.when(k % 4 != 0, text("part | ", k)).alias("summary"), F.array(affected).alias("affected"))
    call = F.when(k % 3 != 2, F.struct(text("GO-", k).alias("key"), F.struct((k % 3 == 0).alias("called")).alias("value")))
    rows = derived.table(spark, sf_dir, "part").groupBy(F.floor(k / 20).alias("report")).agg(F.collect_list(vulnerability).alias("vulnerabilities"), F.collect_list(call).alias("calls"))
    package = F.struct(F.array(F.struct(F.map_from_entries("calls").alias("experimental_analysis"))).alias("groups"), "vulnerabilities")
    result = F.struct(F.struct(F.concat(text("m", F.col("report")), F.lit(".mod")).alias("path")).alias("source"), F.array(package).alias("packages"))
    return rows.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("value"))


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS called FROM part)
    SELECT 'GO-' || CAST(k AS VARCHAR) AS go_id, CASE WHEN k % 2 = 0 THEN 'CVE-' || CAST(k AS VARCHAR) ELSE '' END AS cve, CASE WHEN k % 2 = 0 THEN 'GHSA-' || CAST(k AS VARCHAR) || ';CVE-' || CAST(k AS VARCHAR) ELSE '' END AS aliases,
        CASE WHEN k % 4 = 0 THEN '' ELSE 'part | ' || CAST(k AS VARCHAR) END AS summary, CASE WHEN k % 5 = 0 THEN '' ELSE 'x/' || CAST(k % 7 AS VARCHAR) END AS package, CASE WHEN k % 6 = 0 THEN 'net/http: Get;Post | net' ELSE '' END AS symbols,
        CASE WHEN k % 3 = 0 THEN '0, 2.0' ELSE '0' END AS introduced, '1.' || CAST(k % 9 AS VARCHAR) AS fixed, called, 'm' || CAST(k // 20 AS VARCHAR) || '.mod' AS source_path,
        CASE called WHEN 'true' THEN 'actionable-now' ELSE 'verify-reachability' END AS disposition, CASE called WHEN 'true' THEN 'runtime-upgrade+targeted-hardening' ELSE 'runtime-upgrade' END AS fix_track,
        CASE called WHEN 'true' THEN '{batch.OSV_NOTES[0]}' ELSE '{batch.OSV_NOTES[1]}' END AS notes FROM p""")
def osv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.osv_rows(osv_reports(spark, sf_dir).select(F.from_json("value", batch.OSV).alias("r")).select("r.results"))


@query(r"""WITH f AS (SELECT coalesce(source, '') || '/' || CAST(doc_id // 20 AS VARCHAR) AS folder, CASE WHEN doc_id % 10 = 0 THEN 'INSTRUCTIONS.md' WHEN doc_id % 10 = 1 THEN 'README.md' ELSE 'r' || CAST(doc_id AS VARCHAR) || '.md' END AS name, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS content FROM documents)
    SELECT folder, sha256(bundle) AS bundle_sha256, CAST(strlen(bundle) AS BIGINT) AS bytes, strlen(bundle) > 3000 AS too_long FROM (
        SELECT folder, string_agg('## ' || replace(name, '.md', '') || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY CASE WHEN name = 'INSTRUCTIONS.md' THEN 0 ELSE 1 END, name, content) AS bundle FROM f WHERE name <> 'README.md' AND content <> '' GROUP BY folder) t""")
def rules_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule folder for each source and twenty ids, with the whole texts as rules."""
    docs = derived.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 10
    name = F.when(k == 0, "INSTRUCTIONS.md").when(k == 1, "README.md").otherwise(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(".md")))
    folder = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 20).cast("string"))
    rows = batch.rules_bundle(docs.select(folder.alias("folder"), name.alias("name"), F.col("text").alias("content")))
    return rows.select("folder", F.sha2("bundle", 256).alias("bundle_sha256"), "bytes", "too_long")


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS line_no, 'a/**/**/b' AS rule FROM part WHERE p_partkey % 5 = 0""")
def ignore_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.table(spark, sf_dir, "part")
    content = F.when(F.col("p_partkey") % 5 == 0, "# x/**/**\r\na/**/**/b\r\n").otherwise("# none\na/**/b\n")
    return batch.lint_ignore(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content")))


@query("""SELECT 'net' AS rule, 'd' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE (text LIKE '%http%' OR text LIKE '%@%') AND doc_id % 3 <> 0
    UNION ALL SELECT 'digits', 'd' || CAST(doc_id AS VARCHAR) FROM documents WHERE regexp_matches(text, '[0-9]{3}')""")
def boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers of three digits in the documents' texts; a third of the documents may hold addresses."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    allowed = docs.where("doc_id % 3 = 0").select(F.lit("net").alias("rule"), "path")
    return batch.boundary_hits(docs, {"net": "http|@", "digits": "[0-9]{3}"}, allowed).select("rule", "path")
