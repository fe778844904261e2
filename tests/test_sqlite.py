"""Dates, JSON, collation and bare columns against SQLite itself."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import sqlite as S

DB = sqlite3.connect(":memory:")
TIMES = ["2024-01-31", "2024-02-29 23:59:59.999", "2023-03-01T00:00:00Z", "1999-12-31 12:30", "2024-06-15T08:09:10.1234+05:30", "2024-06-15 08:09:10-11:00", "12:34:56", "2460000.5", "2440587.75", "2024-13-01", "text", "", None, " 2024-05-05 ", "0100-01-01", "9990-06-30"]
STEPS = ["+1 month", "-1 month", "+13 months", "+1 year", "-3 years", "+1 day", "-45 days", "+1.5 days", "+100000 seconds", "-90 minutes", "+5 hours", "start of month", "start of year", "start of day", "weekday 0", "weekday 3", "weekday 6", "+02:30", "-00:45:30", "utc"]
CODES = ["%d", "%f", "%H", "%j", "%m", "%M", "%s", "%S", "%w", "%W", "%Y", "a%%b %Y/%m/%d"]


def sqlite(expression, *values):
    return DB.execute(f"SELECT {expression}", values).fetchone()[0]


def columns(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [tuple(r)[1:] for r in rows.select("i", *[m.alias(f"c{k}") for k, m in enumerate(made)]).orderBy("i").collect()]


def test_chains_of_modifiers_are_those_of_sqlite(spark):
    r = random.Random(4)
    chains = [[]] + [[s] for s in STEPS] + [[r.choice(STEPS) for _ in range(r.choice([2, 3]))] for _ in range(12)]
    got = columns(spark, TIMES, [S.datetime(F.col("v"), *c) for c in chains])
    for value, row in zip(TIMES, got):
        for chain, x in zip(chains, row):
            marks = "".join(", ?" for _ in chain)
            assert x == sqlite(f"datetime(?{marks})", value, *chain), (value, chain)


def test_years_outside_the_range_are_null(spark):
    assert columns(spark, ["9999-12-31", "0000-01-01"], [S.date(F.col("v"), "+1 month"), S.date(F.col("v"), "-1 day"), S.date(F.col("v"))]) == [(None, "9999-12-30", "9999-12-31"), ("0000-02-01", None, "0000-01-01")]


def test_formats_are_those_of_sqlite(spark):
    got = columns(spark, TIMES, [S.strftime(c, F.col("v")) for c in CODES] + [S.date(F.col("v")), S.time(F.col("v")), S.unixepoch(F.col("v"), "+1 day"), S.julianday(F.col("v")), S.strftime("%Q", F.col("v")), S.date(F.col("v"), "+1 fortnight")])
    for value, row in zip(TIMES, got):
        known = [sqlite(f"strftime('{c}', ?)", value) for c in CODES] + [sqlite("date(?)", value), sqlite("time(?)", value), sqlite("CAST(strftime('%s', ?, '+1 day') AS INTEGER)", value)]
        assert list(row[:-3]) == known, value
        assert row[-3] == pytest.approx(sqlite("julianday(?)", value), abs=1e-8) if row[-3] is not None else sqlite("julianday(?)", value) is None
        assert row[-2] is None and row[-1] is None


JSONS = ['{"a": 1, "b": {"c": [1, 2.5, "x", null, true, {"d": "e f"}]}, "s": "q\\"uo\\\\te é", "t": true, "f": false, "n": null, "big": 12345678901, "a.b": 7}', "[10, [20, 30], {}]", '"plain"', "17", "null", "{bad", "", None, "{}"]


def test_json_values_are_those_of_sqlite(spark):
    paths = ["$.a", "$.b.c[0]", "$.b.c[1]", "$.b.c[2]", "$.b.c[3]", "$.b.c[4]", "$.b.c[5].d", "$.b.c[9]", "$.s", "$.t", "$.f", "$.n", "$.big", "$[1][0]", "$.nothing"]
    got = columns(spark, JSONS, [S.json_extract(F.col("v"), p) for p in paths] + [S.json_type(F.col("v"), p) for p in paths] + [S.json_valid(F.col("v"))])
    for value, row in zip(JSONS, got):
        valid = sqlite("json_valid(?)", value)
        assert row[-1] == (None if value is None else valid)
        for k, p in enumerate(paths):
            known, kind = (sqlite("json_extract(?, ?)", value, p), sqlite("json_type(?, ?)", value, p)) if valid else (None, None)
            assert (row[k], row[len(paths) + k]) == (None if known is None else str(known), kind), (value, p)


def test_arrows_and_makers(spark):
    got = columns(spark, JSONS[:2], [S.json_arrow(F.col("v"), "b"), S.json_arrow(F.col("v"), 1), S.json_extract(F.col("v"), "a.b"), S.json_object(x=F.lit(1), y=F.lit(None).cast("string"), z=F.lit('q"')), S.json_array(F.lit(1), F.lit("a"), F.lit(None).cast("int"), F.lit(True))])
    for value, row in zip(JSONS, got):
        assert row[0] == sqlite("? -> 'b'", value) and row[1] == sqlite("? -> 1", value) and row[2] == (None if value[0] == "[" else "7")
        assert row[3] == sqlite("json_object('x', 1, 'y', NULL, 'z', 'q\"')") and row[4] == '[1,"a",null,true]'


def test_json_each_is_the_table_function(spark):
    rows = spark.createDataFrame(list(enumerate(JSONS)), "i int, v string")
    for path in ("$", "$.b.c"):
        got = sorted((r["i"], r["key"], r["value"], r["type"]) for r in S.json_each(rows, "v", path).collect())
        known = []
        for i, v in enumerate(JSONS):
            if v is not None and sqlite("json_valid(?)", v) and sqlite("json_type(?, ?)", v, path) in ("array", "object"):
                known += [(i, str(k), None if x is None else str(x), t) for k, x, t in DB.execute("SELECT key, value, type FROM json_each(?, ?)", (v, path))]
        assert [(a, b, c and c.replace(" ", ""), d) for a, b, c, d in got] == [(a, b, c and c.replace(" ", ""), d) for a, b, c, d in sorted(known)]


def test_collation_and_bare_columns(spark):
    rows = [("Ann", 3, "x"), ("ANN", 5, "y"), ("bob", 1, "z"), ("Bob", 1, "a"), ("ann", 5, "b"), ("", 0, "e")]
    df = spark.createDataFrame(rows, "name string, n int, t string")
    DB.execute("DROP TABLE IF EXISTS c")
    DB.execute("CREATE TABLE c (name TEXT COLLATE NOCASE, n INT, t TEXT)")
    DB.executemany("INSERT INTO c VALUES (?, ?, ?)", rows)
    grouped = {r["k"].lower(): r["n"] for r in df.groupBy(S.nocase(F.col("name")).alias("k")).agg(F.sum("n").alias("n")).collect()}
    assert grouped == {k.lower(): n for k, n in DB.execute("SELECT name, sum(n) FROM c GROUP BY name")}
    assert [r["t"] for r in df.orderBy(S.nocase(F.col("name")), "n", "t").collect()] == [t for (t,) in DB.execute("SELECT t FROM c ORDER BY name, n, t")]
    assert df.where(S.nocase(F.col("name")) == "ANN").count() == 3
    named = spark.createDataFrame([("ANN", 1), ("bOB", 2)], "who string, id int")
    assert df.join(named, S.nocase(F.col("name")) == S.nocase(F.col("who"))).count() == 5
    lowered = df.withColumn("k", F.lower("name"))
    assert sorted(map(tuple, S.bare(lowered, ["k"], "n", ["name", "t"]).collect())) == [("", 0, "", "e"), ("ann", 5, "ANN", "y"), ("bob", 1, "Bob", "a")]
    assert sorted(map(tuple, S.bare(lowered, ["k"], "n", ["t"], largest=False).collect())) == [("", 0, "e"), ("ann", 3, "x"), ("bob", 1, "a")]
