"""Data sources: dumps by byte ranges with pushed filters."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sluicebox.sources import dumps, history

P = "Review Pre-Commit Check:"


def dump_text(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        trailer = r.choice(["", f"{P} ran (iter:{i % 7}, coverage:{i % 101}%)", f"{P} vouched", f"  {P}   skipped", "Other Pre-Commit Check: ran"])
        date = f"2026-{1 + (n - i) % 12:02}-{1 + i % 28:02}T{i % 24:02}:30:00+05:30" if i % 11 else "no date"
        body = f"s{i}\n\n" + "é line\n" * r.randrange(6) + trailer
        fields = [f"\n{i:040x}" if i else f"{i:040x}", f"{i:07x}", f"dev{i % 5}", f"dev{i % 5}@x", date, f"s{i} ñ", body, "2026-05-05T00:00:00Z"]
        out.append("\x1f".join(fields[: r.choice([7, 8])] if i % 9 else fields[:4]))
    return "\x1e".join(out) + r.choice(["", "\x1e\n"])


@pytest.fixture
def dump(tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}").write_text(dump_text(90, k))
    (folder / "_SUCCESS").write_text("")
    return f"file://{folder}"


@pytest.mark.parametrize("split", [37, 500, 4096, 1 << 20])
def test_byte_ranges_give_each_record_once(spark, dump, split):
    expected = sorted(map(tuple, history.parse(history.read_dump(spark, dump), "Review", "dev").collect()))
    got = dumps.read(spark, dump, "Review", branch="dev", splitBytes=str(split))
    assert got.columns == [c.split()[0] for c in history.SCHEMA.split(", ")]
    assert sorted(map(tuple, got.collect())) == expected and len(expected) == 240


def test_pushed_conditions_are_exact(spark, dump):
    every = history.parse(history.read_dump(spark, dump), "Review").cache()
    try:
        for condition in ("author = 'dev3'", "action IN ('reviewed', 'skipped') AND coverage > 40", "date >= '2026-03' AND date < '2026-09-01T00:00:00Z'", "hash LIKE '00000%' AND iterations <= 2", "length(subject) = 4 AND action = 'none'", "author = 'dev1' OR coverage = 7"):
            rows = dumps.read(spark, dump, "Review", splitBytes="700", pushdown="true").where(condition)
            assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, every.where(condition).collect()))
        plan = dumps.read(spark, dump, "Review", pushdown="true").where("author = 'dev3' AND length(subject) = 4")._jdf.queryExecution().executedPlan().toString()
        assert "length(subject" in plan and "= dev3)" not in plan.split("BatchScan")[0]
        read = dumps.read(spark, dump, "Review", pushdown="true")
        assert [read.where("author = 'dev3'").count(), read.count()] == [every.where("author = 'dev3'").count(), every.count()]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_options_are_the_bounds_of_the_log(spark, dump):
    every = history.parse(history.read_dump(spark, dump), "Review").cache()
    bounds = {"from": "2026-03-01", "to": "2026-10-05T12:00:00+02:00", "author": "^dev[13] <.*@x>$", "action": "reviewed"}
    expected = history.bounded(every, bounds["from"], bounds["to"], bounds["author"], bounds["action"]).collect()
    got = dumps.read(spark, dump, "Review", splitBytes="600", **bounds)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected)) and expected
    # Two reads in one query are bounded each by its own options.
    one, two = (dumps.read(spark, dump, "Review", author=f"dev{k}") for k in (1, 2))
    assert {r[0]: r[1] for r in one.unionByName(two).groupBy("author").count().collect()} == {r[0]: r[1] for r in every.where("author IN ('dev1', 'dev2')").groupBy("author").count().collect()}


def test_an_index_leaves_out_ranges(spark, dump, tmp_path):
    out = f"file://{tmp_path}/index"
    dumps.index(spark, dump, "Review", out, split_bytes=900)
    known = {(r["file"], r["start"]): r for r in spark.read.parquet(out).collect()}
    assert sum(r["records"] for r in known.values()) == 240
    reader = dumps.PushedDumpReader({"path": dump, "tool": "Review", "index": out, "splitbytes": "900"}, ["date", "author"])
    assert len(reader.partitions()) == len(known)
    assert list(reader.pushFilters([dumps.GreaterThanOrEqual(("date",), "2026-12-20")])) == []
    kept = {(p.file, p.start) for p in reader.partitions()}
    skipped = [r for k, r in known.items() if k not in kept]
    assert len(skipped) > len(known) / 2 and sum(r["records"] for r in skipped) > 100 and all(r["greatest_date"] < "2026-12-20" for r in skipped)
    read = dumps.read(spark, dump, "Review", splitBytes="900", index=out, **{"from": "2026-12-20"})
    assert read.count() == history.parse(history.read_dump(spark, dump), "Review").where("date >= '2026-12-20'").count() > 0


def test_more_columns_and_missing_paths(spark, dump, tmp_path):
    rows = dumps.read(spark, dump, "Review", body="true", commitDate="true").where("commit_date > ''").collect()
    assert 0 < len(rows) < 240 and all(r["body"].startswith("s") and r["commit_date"] == "2026-05-05T00:00:00Z" for r in rows)
    (tmp_path / "empty").mkdir()
    assert dumps.read(spark, f"{tmp_path}/empty", "Review").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        dumps.read(spark, f"{tmp_path}/nowhere", "Review").count()


def test_bounds_are_times_or_spans_before_now(spark):
    now = datetime(2026, 3, 31, 12, tzinfo=UTC)
    cases = {"2026-01-02": "2026-01-02T00:00:00Z", "2026-01-02T03:04:05+05:30": "2026-01-01T21:34:05Z", "now": "2026-03-31T12:00:00Z", "yesterday": "2026-03-30T12:00:00Z", "2 weeks ago": "2026-03-17T12:00:00Z", "1.week.2.days.ago": "2026-03-22T12:00:00Z", "an hour ago": "2026-03-31T11:00:00Z", "1 month ago": "2026-03-03T12:00:00Z", "2 years ago": "2024-03-31T12:00:00Z"}
    assert {k: history.moment(k, now) for k in cases} == cases
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z")], "date string, commit_date string")
    assert history.bounded(rows, "2026-01-15").count() == 0 and history.bounded(rows, "2026-01-15", by="commit_date").count() == 1


def test_times(spark):
    cases = ["2026-01-02T03:04:05+05:30", " 2026-01-02T03:04:05Z\n", "2026-01-02T03:04:05.25-01:00", "2026-02-30T00:00:00Z", "now", "", "2026-01-02 03:04:05"]
    assert [dumps.utc_text(c) for c in cases] == ["2026-01-01T21:34:05Z", "2026-01-02T03:04:05Z", "2026-01-02T04:04:05Z", "", "", "", ""]
