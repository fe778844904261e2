"""Batch jobs: object retention and audit, release versions, vulnerability reports, rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def retention(versions: DataFrame) -> DataFrame:
    """Versions to delete: all uploads of a name but the newest, and all hides and starts.

    versions: fileName, action, uploadTimestamp, ord (place in the listing).
    """
    place = F.row_number().over(Window.partitionBy("fileName", "action").orderBy(F.desc(F.coalesce("uploadTimestamp", F.lit(0))), "ord"))
    rows = versions.where(F.coalesce("fileName", F.lit("")) != "").withColumn("rn", place)
    return rows.where("action in ('hide', 'start') or (action = 'upload' and rn > 1)").drop("rn")


def audit(versions: DataFrame) -> DataFrame:
    """Counts of all versions, names, names with several versions, and the first 20 of those."""
    names = versions.where(F.coalesce("fileName", F.lit("")) != "").groupBy("fileName").agg(F.count(F.lit(1)).alias("n"))
    total = versions.agg(F.count(F.lit(1)).alias("total_versions"))
    of = names.agg(F.count(F.lit(1)).alias("unique_file_names"), F.count_if(F.col("n") > 1).alias("multi_version_file_names"))
    first = names.where("n > 1").orderBy("fileName").limit(20).agg(F.array_join(F.array_sort(F.collect_list("fileName")), ",").alias("multi_version_samples"))
    return total.crossJoin(of).crossJoin(first)  # one row each


def actions(versions: DataFrame) -> DataFrame:
    return versions.groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def latest(versions: DataFrame, version: str, *keys: str) -> DataFrame:
    """The highest version of each key by its three numbers."""
    return versions.withColumn("v", X.semver(F.col(version))).where("v is not null").groupBy(*keys).agg(F.max_by(version, "v").alias("latest"))


def manifest(artifacts: DataFrame) -> DataFrame:
    """version and a map of its platforms to artifacts (platform, url, ord); the last of a platform counts."""
    last = artifacts.groupBy("version", "platform").agg(F.max_by("url", "ord").alias("url"))
    return last.groupBy("version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "url")))).alias("platforms"))


OSV = """results array<struct<source:struct<path:string>,packages:array<struct<
    groups:array<struct<experimental_analysis:map<string,struct<called:boolean>>>>,
    vulnerabilities:array<struct<id:string,aliases:array<string>,summary:string,affected:array<struct<package:struct<name:string>,
        ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>,
        ecosystem_specific:struct<imports:array<struct<path:string,symbols:array<string>>>>>>>>>>>>"""


#: Notes on vulnerabilities that are called, and on the others.
OSV_NOTES = ("Reachable stdlib path reported by scanner; prioritize Go patch-level/major upgrade.", "Scanner reports not-called; confirm with code-path review before closure.")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def osv_rows(reports: DataFrame) -> DataFrame:
    """A flat row for each vulnerability of each package of parsed reports (column results)."""
    results = reports.select(F.explode("results").alias("r"))
    packages = results.select(_text(F.col("r.source.path")).alias("source_path"), F.explode("r.packages").alias("p"))
    empty_map = F.create_map().cast("map<string,struct<called:boolean>>")
    # Later groups win, as when a dictionary is filled.
    called = F.aggregate(F.coalesce("p.groups", F.array()), empty_map, lambda m, g: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(F.coalesce(g["experimental_analysis"], empty_map), k)), F.coalesce(g["experimental_analysis"], empty_map)))
    rows = packages.withColumn("called_map", called).select("source_path", "called_map", F.explode("p.vulnerabilities").alias("v"))
    affected = F.coalesce("v.affected", F.array())
    events = F.flatten(F.transform(F.flatten(F.transform(affected, lambda a: F.coalesce(a["ranges"], F.array()))), lambda x: F.coalesce(x["events"], F.array())))
    bound = lambda name: F.array_join(F.filter(F.transform(events, lambda e: e[name]), lambda x: x.isNotNull()), ", ")
    imports = F.flatten(F.transform(affected, lambda a: F.coalesce(a["ecosystem_specific"]["imports"], F.array())))
    symbol = lambda i: F.when(F.size(F.coalesce(i["symbols"], F.array())) > 0, F.concat(_text(i["path"]), F.lit(": "), F.array_join(i["symbols"], ";"))).otherwise(_text(i["path"]))
    aliases = F.coalesce("v.aliases", F.array().cast("array<string>"))
    names = F.filter(F.transform(affected, lambda a: _text(a["package"]["name"])), lambda x: x != "")
    state = F.when(F.map_contains_key("called_map", F.col("v.id")), F.coalesce(F.col("called_map")[F.col("v.id")]["called"], F.lit(False)).cast("string")).otherwise("unknown")
    yes = F.col("called") == "true"
    return rows.select(
        _text(F.col("v.id")).alias("go_id"),
        _text(F.try_element_at(F.filter(aliases, lambda x: x.startswith("CVE-")), F.lit(1))).alias("cve"),
        F.array_join(aliases, ";").alias("aliases"),
        _text(F.col("v.summary")).alias("summary"),
        _text(F.try_element_at(names, F.lit(1))).alias("package"),
        F.array_join(F.filter(F.transform(imports, symbol), lambda x: x != ""), " | ").alias("symbols"),
        bound("introduced").alias("introduced"),
        bound("fixed").alias("fixed"),
        state.alias("called"),
        "source_path",
    ).withColumns({
        "disposition": F.when(yes, "actionable-now").otherwise("verify-reachability"),
        "fix_track": F.when(yes, "runtime-upgrade+targeted-hardening").otherwise("runtime-upgrade"),
        "notes": F.when(yes, OSV_NOTES[0]).otherwise(OSV_NOTES[1]),
    })


def disposition_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("called") == x).alias(f"called_{x}") for x in ("true", "false", "unknown")])


def rules_bundle(files: DataFrame, limit: int = 3000) -> DataFrame:
    """Rule files (folder, name, content) of each folder joined to one text: INSTRUCTIONS first, README left out, the rest by name."""
    rows = files.where(F.col("name").endswith(".md") & (F.upper("name") != "README.MD") & (X.strip("content") != ""))
    item = F.struct((F.upper("name") != "INSTRUCTIONS.MD").cast("int").alias("late"), "name", F.concat(F.lit("## "), F.regexp_replace("name", r"\.md$", ""), F.lit("\n\n"), X.strip("content")).alias("text"))
    out = rows.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("bundle"))
    return out.select("folder", "bundle", F.octet_length("bundle").cast("long").alias("bytes"), (F.octet_length("bundle") > limit).alias("too_long"))


def lint_ignore(files: DataFrame) -> DataFrame:
    """path and number of each line of ignore files that has a redundant ``**/**``."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), "\n")).alias("pos", "line"))
    rule = X.strip("line")
    return lines.where((rule != "") & ~rule.startswith("#") & rule.contains("**/**")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), rule.alias("rule"))


def missing_paths(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected paths that are not there."""
    return expected.join(present, "path", "left_anti")


def boundary_hits(sources: DataFrame, rules: dict[str, str], allowed: DataFrame) -> DataFrame:
    """rule and path of each source file whose text matches a rule and that is not allowed to (allowed: rule, path)."""
    found = sources.select("path", F.explode(F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in rules.items()]))).alias("rule"))
    return found.join(allowed, ["rule", "path"], "left_anti")
