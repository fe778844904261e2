"""Trailers, log records, the gate, named queries, rendering and SQLite-like columns."""

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import sqlite as S
from sluicebox.functions import text as X
from sluicebox.plans import catalog, render
from sluicebox.sources import history

P = "Review Pre-Commit Check:"


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_trailers(spark):
    cases = [
        (f"{P} ran", ("reviewed", 0, 0)),
        (f"{P} ran (iter:3, coverage:82%)", ("reviewed", 3, 82)),
        (f"{P} vouched (iter:1,coverage:100%)", ("vouched", 1, 100)),
        (f"{P} skipped", ("skipped", 0, 0)),
        (f"{P} skipped manually", ("skipped", 0, 0)),
        (f"\t  {P}   ran (iter:2, coverage:5%)  ", ("reviewed", 2, 5)),
        ("Signed-off-by: someone", ("none", 0, 0)),
        ("", ("none", 0, 0)),
        (f"{P} other\n{P} vouched (iter:4)\n{P} ran (iter:1, coverage:1%)", ("vouched", 0, 0)),
        (f"see {P} ran", ("none", 0, 0)),
    ]
    rest = lambda c: X.trailer_line(c, "Review")
    got = column(spark, [c for c, _ in cases], lambda c: F.struct(X.trailer_action(rest(c)), X.trailer_metric(rest(c), 1), X.trailer_metric(rest(c), 2)))
    assert [tuple(g) for g in got] == [e for _, e in cases]


def test_a_trailer_that_is_written_reads_back(spark):
    rows = spark.createDataFrame([("reviewed", 2, 49.5), ("vouched", 1, 100.0), ("skipped", 0, 80.0), ("odd", 3, 1.0)], "a string, n long, p double")
    line = X.format_trailer(F.col("a"), F.col("n"), F.col("p"), "Review")
    got = [tuple(r) for r in rows.select(line, X.trailer_action(X.trailer_line(line, "Review"))).collect()]
    assert got == [(f"{P} ran (iter:2, coverage:50%)", "reviewed"), (f"{P} vouched (iter:1, coverage:100%)", "vouched"), (f"{P} skipped", "skipped"), (f"{P} odd (iter:3, coverage:1%)", "none")]


def record(*fields):
    return history.FIELD.join(fields)


def test_dumps_are_read_and_malformed_records_dropped(spark, tmp_path):
    good = record("aa11", "aa", " Ann ", "a@x", "2026-01-02T03:04:05+05:30", "fix: it", f"fix: it\n\n{P} ran (iter:1, coverage:40%)\n")
    plain = record("bb22", "bb", "Bob", "b@x", "not a date", "wip", "wip")
    text = history.RECORD.join([good, "\n" + plain, "\n" + record("too", "few"), "\n"])
    (tmp_path / "dump").write_text(text)
    rows = history.parse(history.read_dump(spark, f"file://{tmp_path}/dump"), "Review", "dev").orderBy("hash").collect()
    assert [tuple(r) for r in rows] == [("aa11", "aa", " Ann ", "a@x", "2026-01-01T21:34:05Z", "dev", "fix: it", "reviewed", 1, 40), ("bb22", "bb", "Bob", "b@x", "", "dev", "wip", "none", 0, 0)]


@pytest.mark.parametrize("sql", ["SELECT 1", "  select 1 ;", "WITH t AS (SELECT 1) SELECT * FROM t", "SELECT 1;", "with x as (select 1) select 1", "SELECT\n1"])
def test_gate_lets_queries_through(sql):
    assert catalog.check_read_only(sql)


@pytest.mark.parametrize("sql", ["", ";", "DROP TABLE t", "DELETE FROM t", "UPDATE t SET a = 1", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE t", "SELECT 1;;", "SELECT ';'", "-- x\nSELECT 1", "VALUES (1)", "EXPLAIN SELECT 1", "PRAGMA x", "CREATE TABLE t (a int)", "ATTACH 'x'"])
def test_gate_stops_the_rest(sql):
    with pytest.raises(catalog.QueryError):
        catalog.check_read_only(sql)


def test_gate_refuses_what_a_plan_would_write_or_reach(spark):
    log = spark.createDataFrame(log_rows(4), history.SCHEMA)
    spark.createDataFrame([(1,)], "a int").write.mode("overwrite").saveAsTable("victim")
    bad = [
        "WITH t AS (SELECT 7 AS a) INSERT INTO victim SELECT a FROM t",
        "WITH t AS (SELECT 7 AS a) FROM t INSERT OVERWRITE victim SELECT a",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM (SELECT java_method('java.util.UUID', 'randomUUID'))",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM review_log WHERE EXISTS (SELECT * FROM text.`/etc/hosts`)",
        "SELECT (1",
        "SELECT TRANSFORM (hash) USING 'id' AS (h) FROM review_log",
        "WITH t AS (FROM review_log SELECT TRANSFORM (hash) USING 'id' AS (h)) SELECT * FROM t",
        "SELECT * FROM review_log WHERE hash IN (SELECT TRANSFORM (hash) USING 'id' AS (h) FROM review_log)",
        "SELECT system.builtin.reflect('java.util.UUID', 'randomUUID')",
        "SELECT count(*) FROM review_log HAVING max(try_reflect('java.util.UUID', 'randomUUID')) > ''",
        "SELECT nosuchfunction(hash) FROM review_log",
        "SELECT * FROM nosuchtable(3)",
        "SELECT sum(coverage) OVER (PARTITION BY reflect('java.util.UUID', 'randomUUID')) FROM review_log",
    ]
    for sql in bad:
        with pytest.raises(catalog.QueryError):
            catalog.run(log, sql)
    assert [tuple(r) for r in spark.table("victim").collect()] == [(1,)]
    spark.sql("DROP TABLE victim")
    twice = "WITH a AS (SELECT author FROM review_log) SELECT count(*) AS n FROM a JOIN review_log USING (author) WHERE author NOT IN (SELECT author FROM review_log WHERE iterations > 9)"
    assert catalog.run(log, twice).first()["n"] == 4


@pytest.mark.parametrize("sql,n", [
    ("SELECT hash FROM review_log WHERE action = 'reflect' OR subject = 'java_method'", 0),
    ("SELECT author AS reflect, count(*) AS n FROM review_log GROUP BY ALL ORDER BY ALL LIMIT 1", 1),
    ("SELECT * FROM review_log PIVOT (count(hash) FOR action IN ('reviewed', 'none')) LIMIT 1", 1),
    ("SELECT * FROM (SELECT hash, iterations, coverage FROM review_log) UNPIVOT (v FOR k IN (iterations, coverage))", 8),
    ("SELECT r.hash, x.c FROM review_log r, LATERAL (SELECT explode(split(r.author, '')) AS c) x WHERE c = 'd'", 4),
    ("SELECT hash, w FROM review_log LATERAL VIEW explode(split(email, '@')) e AS w", 8),
    ("SELECT i FROM range(3) AS t(i) UNION ALL SELECT 7 INTERSECT SELECT 7", 4),
    ("SELECT author, grouping(action) AS g FROM review_log GROUP BY ROLLUP (author, action) HAVING count(*) > 0 AND author IS NULL", 1),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t", 5),
    ("SELECT DISTINCT if(coverage > 1, 'a', 'b') AS x FROM review_log WHERE EXISTS (SELECT 1 FROM VALUES (1) AS v(a)) AND cast(date AS date) IS NOT NULL AND hash LIKE '%'", None),
    ("SELECT count(*) FILTER (WHERE iterations BETWEEN 0 AND 9) AS n, percentile_approx(coverage, 0.5) AS p FROM review_log", 1),
])
def test_gate_lets_all_kinds_of_reading_through(spark, sql, n):
    got = catalog.run(spark.createDataFrame(log_rows(4), history.SCHEMA), sql).count()
    assert n is None or got == n


def test_trailers_of_other_tools_are_none(spark):
    rows = spark.createDataFrame([("Other Pre-Commit Check: ran",), ("XReview Pre-Commit Check: ran",), ("Re.iew Pre-Commit Check: ran",), (f"  {P} ran",)], "m string")
    assert [r[0] for r in rows.select(X.trailer_action(X.trailer_line(F.col("m"), "Review"))).collect()] == ["none", "none", "none", "reviewed"]
    assert [r[0] for r in rows.select(X.trailer_action(X.trailer_line(F.col("m"), "Re.iew"))).collect()] == ["none", "none", "reviewed", "none"]


def test_arguments():
    a = catalog.Arguments.parse(["stats", "--json", "--from=2026-01-01", "--to", "2026-02-01", "--range", "a..b"])
    assert (a.words, a.json, a.start, a.end, a.range) == (["stats"], True, "2026-01-01", "2026-02-01", "a..b")
    assert catalog.Arguments.parse(["SELECT", "1", "-j"]).words == ["SELECT", "1"]
    for last in ("--from", "--to", "--range"):
        with pytest.raises(catalog.QueryError):
            catalog.Arguments.parse(["stats", last])


def test_catalog(tmp_path):
    c = catalog.Catalog(str(tmp_path / "queries.toml"))
    assert [n for n, _, _ in c.listing()] == ["by-author", "recent", "stats"]
    c.add(" mine ", 'SELECT "a" FROM review_log')
    c.add("stats", "SELECT 1;")
    assert c.resolve("mine") == 'SELECT "a" FROM review_log' and c.resolve("stats") == "SELECT 1"
    assert ("stats", "SELECT 1", "user") in c.listing()
    c.delete("stats")
    assert "GROUP BY action" in c.resolve("stats")
    for call in (lambda: c.delete("stats"), lambda: c.delete("none"), lambda: c.add("a.b", "SELECT 1"), lambda: c.add("x", "DROP TABLE t")):
        with pytest.raises(catalog.QueryError):
            call()
    (tmp_path / "queries.toml").write_text("other = 1\n")
    with pytest.raises(catalog.QueryError):
        c.listing()


def log_rows(n):
    cycle = ["reviewed", "vouched", "skipped", "none"]
    return [(f"{i:040x}", f"{i:07x}", f"dev{i % 10}", f"dev{i % 10}@example.com", f"2026-01-01T{i % 24:02}:00:00Z", "main", "s", cycle[i % 4], i % 5, i % 101) for i in range(n)]


def test_groups_and_empty_logs(spark):
    log = spark.createDataFrame(log_rows(8), history.SCHEMA)
    assert sorted(tuple(r) for r in catalog.run(log, "SELECT action, count(*) FROM review_log GROUP BY action").collect()) == [(a, 2) for a in ("none", "reviewed", "skipped", "vouched")]
    assert [tuple(r) for r in catalog.run(spark.createDataFrame([], history.SCHEMA), "SELECT count(*) FROM review_log").collect()] == [(0,)]
    assert catalog.run(log, "recent").count() == 8


def test_commands_over_a_dump(spark, tmp_path):
    records = [record(f"h{i}", f"{i}", "Ann", "a@x", f"2026-01-{i:02}T00:00:00Z", "s", f"{P} ran") for i in range(1, 10)]
    (tmp_path / "d").write_text(history.RECORD.join(records))
    rows, args = catalog.command(spark, f"file://{tmp_path}/d", ["stats", "--from", "2026-01-03", "--to=2026-01-05", "-j"], "Review")
    columns, cells = render.rows_of(rows)
    assert args.json and render.json_rows(columns, cells) == '[{"Action":"reviewed","Commits":"3","AvgIter":"0","AvgCoveragePct":"0"}]'
    with pytest.raises(catalog.QueryError):
        catalog.command(spark, "unused", ["--json"], "Review")


def test_rendering():
    table = render.text_table(["Action", "Commits", "AvgIter"], [["skipped", "225", "1.2"], ["none", "112", "0"]])
    assert table == "Action   Commits  AvgIter\n-------  -------  -------\nskipped  225      1.2\nnone     112      0\n"
    assert render.text_table([], []) == "(no columns)\n" and render.text_table(["a"], []) == "a\n-\n(no rows)\n"
    assert render.json_rows(["b", "a"], [["<x>", 'q"']]) == '[{"b":"\\u003cx\\u003e","a":"q\\""}]' and render.json_rows(["a"], []) == "[]"
    assert [render.cell(x) for x in (None, 4.0, 0.0, 30.9, 7, "t", 2.5)] == ["", "4", "0", "30.9", "7", "t", "2.5"]
    assert render.text_table(["é", "b"], [["x", "y"]]) == "é  b\n--  -\nx   y\n"


def test_sqlite_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(S.divide(lit(5), lit(2))) == 2 and one(S.divide(lit(-5), lit(2))) == -2 and one(S.divide(lit(1), lit(0))) is None
    big = lit(9007199254740993)
    assert one(S.divide(big, lit(1))) == 9007199254740993 and one(S.divide(big, lit(-2))) == -4503599627370496 and one(S.divide(lit(None).cast("long"), lit(2))) is None
    assert one(S.substr(lit("hello"), 0, 3)) == "he" and one(S.substr(lit("hello"), 2, 3)) == "ell"
    assert one(S.glob(lit("a1b"), "a[0-9]*")) and not one(S.glob(lit("A1b"), "a*")) and one(S.glob(lit("a.b"), "a.?"))
    assert one(S.greatest(lit(1), lit(3))) == 3 and one(S.greatest(lit(1), lit(None))) is None and one(S.least(lit(1), lit(3))) == 1
    assert one(S.number(lit("12abc"))) == 12 and one(S.number(lit("abc"))) == 0 and one(S.number(lit(" -1.5e2x"))) == -150
    assert one(S.strip_chars(lit("xxhixx"), "x", "left")) == "hixx" and one(S.strip_chars(lit("xxhixx"), "x")) == "hi"
    assert one(S.ascii_upper(lit("aé"))) == "Aé" and one(S.iif(lit(False), lit(1), lit(2))) == 2
    assert one(S.strftime("%Y week:%m", lit("2026-03-04"))) == "2026 week:03" and one(S.unixepoch(lit("1970-01-02"))) == 86400
    assert one(S.julianday(lit("2000-01-01 12:00:00"))) == 2451545.0 and one(S.like(lit("ABC"), "a%"))
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert rows.agg(S.group_concat(F.col("v"), ",", F.col("k")).alias("x"), S.total(F.col("k")).alias("t")).first() == ("a,b", 3.0)
    assert rows.where("false").agg(S.total(F.col("k")).alias("t")).first() == (0.0,)


def test_text_columns(spark):
    assert column(spark, ["msg\r\n\n", "a\x07b\tc"], X.sanitize_message) == ["msg", "ab\tc"]
    assert column(spark, [f"# c\n\nkeep\n{P} ran\n two "], lambda c: X.initial_message(c, "Review")) == ["keep\n two"]
    assert column(spark, ["text\n ## Head it \nmore", "none"], X.first_heading) == ["Head it", ""]
    assert column(spark, ["a  b\nc", "x" * 70], lambda c: X.preview(c, 60)) == ["a b c", "x" * 59 + "…"]
    assert column(spark, [["a", "b", "c"], ["a"]], lambda c: X.capped_list(c, 2), "array<string>") == ["a, b and 1 more", "a"]
    assert column(spark, ["", " one  two\n"], X.word_count) == [0, 2]
    assert column(spark, [0, 3, 20, 400], X.read_seconds, "long") == [5, 5, 10, 12]
    assert column(spark, ["## Technical  Highlights!"], X.normal_heading) == ["technical highlights"]
    assert column(spark, [None, -1, 400, 61_000, 3_600_000, 3_725_000], X.duration, "long") == ["", "", "0s", "1m 1s", "1h", "1h 2m"]
    assert column(spark, ["src/a-b.go"], X.file_id) == ["file_src_a_b_go"]
    assert [tuple(x) if x else x for x in column(spark, ["v1.2.10", "x", "rel 0.5.7"], X.semver)] == [(1, 2, 10), None, (0, 5, 7)]
    assert column(spark, ["12", "0", "x", "-3"], X.positive_id) == [12, None, None, None]
    assert column(spark, ["gpt-4", "brave otter 7", "My key"], lambda c: X.likely_auto_name(c, ["gpt"], ["brave", "otter"])) == [True, True, False]


def test_ranges_and_paths(spark):
    log = spark.createDataFrame(log_rows(6), history.SCHEMA)
    pick = lambda *i: log.where(F.col("coverage").isin(list(i)))
    cov = lambda df: sorted(r["coverage"] for r in df.collect())
    assert cov(history.in_range(log, pick(0, 1, 2), pick(1, 2, 3, 4))) == [3, 4]
    assert cov(history.in_range(log, pick(0, 1, 2), pick(1, 2, 3, 4), symmetric=True)) == [0, 3, 4]
    changes = log.select("hash", F.when(F.col("coverage") < 2, "src/a").otherwise("doc/b").alias("path"))
    assert cov(history.touching(log, changes, "src/")) == [0, 1]
    assert cov(history.bounded(log, author="dev3", action="none")) == [3]
