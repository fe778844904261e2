"""Coverage, sessions, diffs, comments, facets, events, decisions, usage, slides and batch jobs."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from sluicebox.sources import derived
from sluicebox.functions import diff as D
from sluicebox.operators import batch, coverage, facets, navigation, slides, usage
from sluicebox.operators import comments as C
from sluicebox.sources import sessions as store
from sluicebox.streaming import decisions, events


def files(*entries):
    return json.dumps([{"file_path": p, "hunks": [{"old_start_line": 0, "old_line_count": 0, "new_start_line": a, "new_line_count": n} for a, n in hunks]} for p, hunks in entries])


SESSIONS = [
    (1, "t1", "main", "reviewed", "2026-03-17T00:00:00Z", files(("a", [(1, 5)])), "r1"),
    (2, "t2", "main", "skipped", "2026-03-18T00:00:00Z", files(("b", [(1, 5)])), "r2"),
    (3, "t3", "main", "reviewed", "2026-03-19T00:00:00Z", "not json", "r3"),
    (4, "t9", "side", "reviewed", "2026-03-19T00:00:00Z", "[]", "r4"),
]
CURRENT = [(9, "now", "main", "reviewed", "2026-03-20T00:00:00Z", files(("a", [(1, 10), (20, 0)]), ("b", [(1, 4)]), ("c", [(3, 3)])), "r9")]


def prior(spark, sessions, changed, ranges):
    rows = coverage.prior_coverage(spark.createDataFrame(sessions, store.SCHEMA), spark.createDataFrame(CURRENT, store.SCHEMA), spark.createDataFrame(changed, "tree1 string, tree2 string, file_path string"), spark.createDataFrame(ranges, 'tree1 string, tree2 string, file_path string, start int, `end` int'))
    return tuple(rows.first())[2:]


def test_prior_coverage(spark):
    changed = [("t1", "now", "a"), ("t1", "now", "b"), ("t3", "now", "a")]
    ranges = [("t1", "now", "a", 2, 4), ("t1", "now", "a", 9, 8), ("t1", "now", "b", 1, 1)]
    # c is unchanged since t1; a was looked at and lost three lines; b was not looked at by a review.
    iterations, reviews, total, covered, pct = prior(spark, SESSIONS, changed, ranges)
    assert (iterations, reviews, total, covered) == (4, 2, 17, 10) and pct == pytest.approx(10 / 17 * 100)
    assert prior(spark, [], changed, ranges) == (1, 0, 17, 0, 0.0)
    same_tree = [(1, "now", "main", "reviewed", "t", "not json", "r")]
    assert prior(spark, same_tree, changed, ranges)[3] == 17


def test_session_store(spark, tmp_path):
    s = store.SessionStore(spark, f"file://{tmp_path}/sessions")
    assert s.read().count() == 0 and s.delete_branch("main") == 0
    s.append(spark.createDataFrame(SESSIONS, store.SCHEMA))
    assert s.count("main") == 3 and [r["id"] for r in s.reviewed("main").collect()] == [1, 3]
    assert s.delete_branch("main", dry_run=True) == 3 and s.count("main") == 3
    assert s.delete_branch("main") == 3 and s.count("main") == 0 and s.count("side") == 1
    empty = spark.createDataFrame([], "tree1 string, tree2 string, file_path string")
    out = s.record(spark.createDataFrame(CURRENT, store.SCHEMA), empty, empty.selectExpr("*", "1 as start", "1 as `end`"))
    assert out.first()["iterations"] == 1 and s.count("main") == 1
    with pytest.raises(ValueError):
        s.delete_all()
    assert s.delete_all(confirmed=True) == 2 and s.read().count() == 0


DIFF = """intro
diff --git a/src/x.go b/src/x.go
index 1..2
@@ -1,3 +1,4 @@ head
 keep
-old
+new

+more
@@ -10 +12,0 @@
-gone
diff --git a/build/out b/build/out
@@ -1 +1 @@
+b
diff --git a/my file.txt b/my file.txt
@@ -1 +1 @@
+c
"""


def test_hunks_and_lines(spark):
    d = spark.createDataFrame([(1, DIFF), (2, "")], "id int, diff string")
    got = d.where("id = 1").select(F.explode(D.hunk_ranges(F.col("diff"))).alias("h")).select("h.*").collect()
    assert [tuple(r) for r in got] == [(1, 3, 1, 4), (10, 1, 12, 0), (1, 1, 1, 1), (1, 1, 1, 1)]
    lines = D.diff_lines(d, "id", "diff").where("file_path = 'src/x.go'").orderBy("pos").collect()
    assert [(r["kind"], r["old_line"], r["new_line"], r["content"]) for r in lines] == [("context", 1, 1, "  keep"), ("del", 2, None, "old"), ("add", None, 2, "new"), ("add", None, 3, "more"), ("del", 10, None, "gone")]


@pytest.mark.parametrize("patterns,excluded", [([], []), (["build/"], ["build/out"]), (["build/", "!build/out"], []), (["*.txt"], ["my file.txt"]), (["/out"], []), (["**/x.go", "*"], ["src/x.go", "build/out", "my file.txt"])])
def test_ignored_sections(spark, patterns, excluded):
    r = D.diff_sections(spark.createDataFrame([(1, DIFF)], "id int, diff string"), "id", "diff", patterns).first()
    assert r["excluded"] == excluded and r["kept"].startswith("intro\n") and r["kept"].count("diff --git") == 3 - len(excluded)
    assert excluded or r["kept"] == DIFF


def test_comments_on_lines(spark):
    lines = spark.createDataFrame([("f", 1, "del", 5, None), ("f", 2, "add", None, 5), ("f", 3, "context", 6, 6)], "file_path string, pos int, kind string, old_line int, new_line int")
    notes = spark.createDataFrame([("f", 5, "a"), ("f", 6, "b"), ("f", 9, "c")], "file_path string, line int, comment_id string")
    on = {r["pos"]: r["comment_id"] for r in C.on_added_lines(lines, notes).collect()}
    assert on == {1: None, 2: "a", 3: None}
    assert sorted((r["comment_id"], r["pos"]) for r in C.consume_once(lines, notes).collect()) == [("a", 1), ("b", 3)]
    fs = spark.createDataFrame([("f", 0, ["x"]), ("f", 1, []), ("g", 2, [])], "file_path string, idx int, comments array<string>")
    new = spark.createDataFrame([("f", 2, "q"), ("f", 1, "p"), ("zz", 1, "r")], "file_path string, seq int, comment string")
    assert {(r["file_path"], r["idx"]): r["comments"] for r in C.append_streamed(fs, new).collect()} == {("f", 0): ["x"], ("f", 1): ["p", "q"], ("g", 2): []}
    shown = C.excerpt(lines.withColumn("content", F.col("kind")), 1).where("pos = 2").first()["excerpt"]
    assert shown == "  del\n> add\n  context"


COMMENTS = [
    ("README.md", 12, "CRITICAL", "High", "doc", "Docs", "Broken links", "one", 1),
    ("README.md", 20, "WARNING", "low", "doc", "docs", "Missing", "two", 2),
    ("parser.go", 7, "ERROR", "High", "bug", "Logic", "", "three", 3),
    ("parser.go", 13, " info ", "", "nit", "Style", "Naming", "four", 4),
]


def comments(spark):
    return spark.createDataFrame(COMMENTS, "file_path string, line int, severity string, confidence string, type string, category string, subcategory string, content string, ord int")


def test_facets(spark):
    off = {"category": ["logic", "STYLE"]}
    got = {(r["facet"], r["value"]): (r["label"], r["count"], r["active"]) for r in facets.facet_counts(comments(spark), off).collect()}
    assert got[("severity", "critical")] == ("Critical", 1, True) and got[("severity", "info")] == ("Info", 0, True)
    assert got[("category", "docs")] == ("Docs", 2, True) and got[("category", "logic")] == ("Logic", 1, False)
    scoped = {r["value"]: r["count"] for r in facets.scoped_subcategories(comments(spark), off).collect()}
    assert scoped == {"broken links": 1, "missing": 1}
    n = facets.issue_counts(comments(spark), off).first()
    assert (n["total"], n["visible"], n["critical"], n["warning"], n["info"]) == (4, 2, 1, 1, 2)
    hidden = facets.shaped(comments(spark).where("ord = 1")).select(facets.visibility_key().alias("key"))
    n = facets.issue_counts(comments(spark), off, hidden).first()
    assert (n["total"], n["visible"], n["critical"]) == (4, 1, 1)
    tree = {r["value"]: (r["count"], r["active"], [(s["value"], s["count"], s["active"]) for s in r["subcategories"]]) for r in facets.category_tree(comments(spark), off | {"subcategory": ["missing"]}).collect()}
    assert tree == {"docs": (2, True, [("broken links", 1, True), ("missing", 1, False)]), "logic": (1, False, []), "style": (1, False, [("naming", 1, False)])}
    assert [r["value"] for r in spark.createDataFrame([("low",), ("zz",), ("high",), ("aa",)], "value string").orderBy(*facets.preferred(facets.CONFIDENCES, F.col("value"))).collect()] == ["high", "low", "aa", "zz"]
    sets = spark.createDataFrame([(["a"], "b"), (["a", "b"], "a")], "s array<string>, v string")
    assert [r["x"] for r in sets.select(facets.toggle(F.col("s"), F.col("v")).alias("x")).collect()] == [["a", "b"], ["b"]]


EVENTS = "id string, type string, time timestamp, level string, batchId string, data string, seq int, review int"


def event_rows():
    from datetime import datetime as dt

    note = {"file_path": "a.go", "line": "3", "content": " hm ", "severity": "CRITICAL", "category": " "}
    bad = [note | {"is_internal": True}, note | {"line": "0"}, note | {"content": " "}, note | {"file_path": ""}]
    at = lambda s: dt(2026, 1, 1, 10, 0, s)
    return [
        ("1", "log", at(1), "info", None, '{"message": "start"}', 1, 1),
        ("2", "batch", at(2), None, "b1", json.dumps({"status": "completed", "comments": [note, *bad]}), 2, 1),
        ("2", "batch", at(2), None, "b1", json.dumps({"status": "completed", "comments": [note]}), 3, 1),
        ("", "status", at(4), None, "b", '{"status": "running"}', 4, 1),
        ("", "status", at(4), None, "b", '{"status": "running"}', 5, 1),
        ("9", "completion", at(5), None, None, '{"errorSummary": "", "batchCount": 1}', 6, 1),
        ("8", "status", at(3), None, None, '{"status": ""}', 7, 1),
        ("7", "batch", at(3), None, "b2", '{"status": "pending", "comments": []}', 8, 2),
    ]


def test_events(spark):
    rows = spark.createDataFrame(event_rows(), EVENTS)
    assert events.deduplicate(rows).count() == 6
    mark = events.bookmark(rows).first()
    assert (mark["last_seen"].second, mark["since"].second) == (5, 4)
    (one, two) = events.comments(rows).collect()
    assert (one["file_path"], one["line"], one["content"], one["severity"], one["category"]) == ("a.go", 3, "hm", "critical", "review") and two["content"] == "hm"
    assert {r["review"]: r["status"] for r in events.status(rows, "review").collect()} == {1: "completed", 2: ""}
    assert events.message(rows.where("seq = 6")).first()["message"] == "Process completed with 0 comments"
    texts = [
        ("log", None, r'{"message": "a\\nb \\t\\\"c"}', 'a\nb   "c'), ("batch", None, '{"status": "processing", "fileCount": 1}', "Batch unknown started: processing 1 file"),
        ("batch", "7", '{"status": "completed", "commentCount": 2}', "Batch 7 completed: generated 2 comments"), ("batch", "7", "{}", "Batch 7: unknown status"), ("status", None, "{}", "Status: unknown"),
        ("artifact", None, '{"url": "u", "kind": "report"}', "Generated: report"), ("artifact", None, '{"kind": ""}', "Artifact: unknown"),
        ("completion", None, '{"resultSummary": "fine", "commentCount": 3}', "fine"), ("completion", None, '{"commentCount": 1}', "Process completed with 1 comment"), ("odd", None, '{"a":1}', '{"a":1}'), ("odd", None, None, "{}"),
    ]
    told = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "seq int, type string, batchId string, data string, want string")
    assert all(r["message"] == r["want"] for r in events.message(told).collect())
    # Events without an id are told apart by their number, and parts that are missing keep their place.
    alike = [(None, "log", None, "b", "x", 1), (None, "log", None, "b", "x", 2), (None, "log", None, None, "x", 3), (None, "log", "b", None, "x", 3), ("", "log", None, "", "x", 4), ("", "odd", None, "", "y", 5)]
    kept = events.deduplicate(spark.createDataFrame(alike, "id string, type string, time string, batchId string, data string, seq int")).collect()
    assert sorted(r["seq"] for r in kept) == [1, 2, 3, 3, 4]
    # Comments count, not batches: the second review's batch has none.
    perf = {r["review"]: (r["elapsed_ms"], r["first_comment_ms"], r["first_comment"], r["total_comments"]) for r in events.performance(rows, "review").collect()}
    assert perf == {1: (4000, 1000, "1s", 2), 2: (0, None, "Waiting", 0)}
    done = rows.where("type = 'completion' OR seq = 7").withColumn("data", F.lit("{}"))
    assert [(r["first_comment"], r["total_comments"]) for r in events.performance(done, "review").collect()] == [("No comments", 0)]
    # The order of keys in data does not tell events apart.
    twins = spark.createDataFrame([(None, "log", None, "b", '{"a": 1, "b": {"c": 2, "d": 3}}', 1), (None, "log", None, "b", '{"b": {"d": 3, "c": 2}, "a": 1}', 1)], "id string, type string, time string, batchId string, data string, seq int")
    assert events.deduplicate(twins).count() == 1


def test_events_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(event_rows(), EVENTS)
    rows.repartition(1).write.parquet(f"file://{tmp_path}/in/1")
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in/*")
    q = events.maintain(events.deduplicate(stream, "1 second"), lambda df, n: got.extend(r["event_key"] for r in df.collect()), f"file://{tmp_path}/cp")
    assert q.awaitTermination(120)
    assert len(got) == len(set(got)) == 6
    rows.repartition(1).write.parquet(f"file://{tmp_path}/in/2")
    q = events.maintain(events.deduplicate(stream, "1 second"), lambda df, n: got.extend(r["event_key"] for r in df.collect()), f"file://{tmp_path}/cp")
    assert q.awaitTermination(120)
    assert len(got) == len(set(got))


SCENARIO = "scenario_id long, seq long, event string, source string, code int, message string, start_complete boolean, precommit boolean, push boolean, initial_message string, editor_message string"
T, W = "terminal", "web"
#: name: (start complete, precommit, initial, editor, events), (code, exit, message, marker, override)
CASES = [
    ((True, True, "cli", "", [(T, 0, "", False)]), (0, 0, "cli", False, "cli")),
    ((False, True, "cli", "", [(T, 2, "", False)]), (2, 2, "", False, "")),
    ((False, True, "cli", "", [(T, 4, "", False)]), (4, 2, "", False, "")),
    ((False, True, "cli", "", [(T, 1, "", False)]), (1, 1, "", False, "")),
    ((True, True, "cli", "ed", [(T, 0, "", False)]), (0, 0, "ed", False, "ed")),
    ((False, False, "", "", [(T, 2, "", False)]), (2, 0, "", False, "")),
    ((False, False, "", "", [(T, 4, "", False)]), (4, 0, "", False, "")),
    ((True, False, "cli", "ed", [(W, 0, "web", False)]), (0, 0, "web", False, "")),
    ((True, True, "cli", "", [(W, 0, "web", True)]), (0, 0, "web", True, "web")),
    ((False, False, "", "", [(T, 2, "", False), (W, 0, "web", False)]), (2, 0, "", False, "")),
    ((True, False, "", "", [(W, 0, "web", False), (T, 1, "", False)]), (0, 0, "web", False, "")),
    ((False, False, "cli", "", [None, (T, 0, "", False)]), (0, 0, "cli", False, "")),
    ((False, False, "cli", "", [(W, 0, "web", False), None, (W, 0, "web", False)]), (0, 0, "web", False, "")),
    ((True, False, "cli", "", [(W, 0, "", False), (T, 2, "", False), (T, 5, "", False)]), (5, 0, "", False, "")),
    ((True, False, "cli", "", [(T, 4, "", False)]), None),
]


def scenario_rows():
    out = []
    for i, ((complete, pre, initial, editor, steps), _) in enumerate(CASES):
        for k, s in enumerate(steps):
            out.append((i, k, "poll" if s is None else "decision", s and s[0], s and s[1], s and s[2], complete, pre, s and s[3], initial, editor))
    return out


def test_decisions(spark):
    rows = spark.createDataFrame(scenario_rows(), SCENARIO)
    got = {r["scenario_id"]: (r["decision_code"], r["exit_code"], r["final_message"], r["push_marker"], r["override"]) for r in decisions.results(rows).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES) if e}
    why = [r["outcome"] for r in decisions.outcomes(rows).where("scenario_id = 13").orderBy("seq").collect()]
    assert why == ["empty-web-message", "invalid-phase", "accepted"]


def test_the_runtime_takes_a_late_skip(spark):
    rows = spark.createDataFrame([(1, 1, "poll", None, None, None), (1, 2, "decision", "web", 2, ""), (1, 3, "decision", "web", 0, "m"), (2, 1, "poll", None, None, None), (2, 2, "decision", "terminal", 0, "m"), (2, 3, "decision", "web", 4, "")], "scenario_id long, seq long, event string, source string, code int, message string").withColumn("start_complete", F.lit(False))
    of = lambda late: [r["outcome"] for r in decisions.outcomes(rows, late_skip=late).orderBy("scenario_id", "seq").collect()]
    assert of(False) == ["invalid-phase", "accepted", "accepted", "already-resolved"] and of(True) == ["accepted", "already-resolved", "accepted", "already-resolved"]


def test_decision_messages_are_whole(spark, tmp_path):
    from sluicebox.queries import reviews

    text = "a message of more than twenty characters " * 9
    spark.createDataFrame([(6, 5, "user", text)], "conv_id long, turn int, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    row = reviews.decision_messages(spark, f"file://{tmp_path}").first()
    assert row["final_message"] == row["override"] == text
    assert reviews.decision_first_valid(spark, f"file://{tmp_path}").first()["outcome"] == "accepted"


def test_decisions_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(scenario_rows(), SCENARIO)
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = decisions.stream_decisions(stream).writeStream.format("memory").queryName("won").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["scenario_id"]: r["code"] for r in spark.table("won").collect()} == {i: e[0] for i, (_, e) in enumerate(CASES) if e}


def test_drafts(spark):
    rows = [(1, 1, "update", "a", 0), (1, 2, "update", "b", 1), (1, 3, "update", "c", 1), (1, 4, "freeze", None, 0), (1, 5, "update", "d", 9), (2, 1, "update", "x", 7)]
    got = [(r["draft_id"], r["result"], r["version"]) for r in decisions.draft_updates(spark.createDataFrame(rows, "draft_id long, seq long, kind string, text string, expected long")).orderBy("draft_id", "seq").collect()]
    assert got == [(1, "accepted", 1), (1, "accepted", 2), (1, "refused-stale", 2), (1, "frozen", 2), (1, "refused-frozen", 2), (2, "accepted", 1)]


def test_web_statuses(spark):
    rows = spark.createDataFrame([("GET", "/skip", 2, False, ""), ("POST", "/x", 2, False, ""), ("POST", "/skip", 2, True, ""), ("POST", "/commit", 0, True, " "), ("POST", "/commit", 0, True, "m")], "m string, p string, c int, done boolean, t string")
    assert [r[0] for r in rows.select(decisions.web_status(*[F.col(c) for c in rows.columns])).collect()] == [405, 404, 409, 400, 200]


def test_usage(spark):
    orgs = spark.createDataFrame([(i,) for i in range(1, 6)], "org_id long")
    quota = spark.createDataFrame([(1, "loc_100k", None, 82000, 100000, 10, "r1", False), (2, "", "free", 15000, 0, None, "", False), (3, "team_32usd", None, 0, 0, None, "q", False)], "org_id long, plan_code string, plan_type string, used long, quota_limit long, pct int, reset_at string, blocked boolean")
    billing = spark.createDataFrame([(3, " loc_200k ", 500000, "2026-02-01")], "org_id long, plan_code string, used long, period_end string")
    plans = spark.createDataFrame([("loc_200k", 250000)], "plan_code string, monthly_limit long")
    subscription = spark.createDataFrame([(4, "Team")], "org_id long, plan_type string")
    got = {r["org_id"]: tuple(r)[1:] for r in usage.merge(orgs, quota, billing, plans, subscription).collect()}
    assert got == {1: ("loc_100k", 82000, 100000, 82, "r1", True), 2: ("free_30k", 15000, 30000, 50, "", True), 3: ("loc_200k", 500000, 250000, 100, "2026-02-01", True), 4: ("team_32usd", 0, 100000, 0, "", True), 5: ("", 0, 0, 0, "", False)}
    members = spark.createDataFrame([(1, i, None if i % 2 else f"m{i}@x", "System" if i == 1 else "user", 100 - i // 2) for i in range(6)], "org_id long, member_id long, email string, kind string, loc long")
    assert [(r["label"], r["loc"]) for r in usage.top_members(members).orderBy("place").collect()] == [("m0@x", 100), ("System", 100), ("m2@x", 99)]


def test_slides(spark):
    body = "## Overview\n\nalpha beta gamma delta epsilon\n\n# Highlights\n\n" + "word " * 20 + "\n\n### Impact!\n"
    rows = spark.createDataFrame([(1, body + "it matters much"), (2, body + "two words"), (3, "# Overview\n" + "w " * 30), (4, "few"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["reason"] for r in slides.eligibility(rows).collect()}
    assert got == {1: "ok", 2: "empty-required-sections", 3: "missing-required-sections", 4: "too-short", 5: "empty-summary"}
    made = slides.remaining(slides.slides(rows.where("doc_id = 1"))).orderBy("n").collect()
    assert [(r["n"], r["title"], r["read_seconds"], r["remaining_seconds"]) for r in made] == [(1, "Overview", 5, 20), (2, "Highlights", 10, 15), (3, "Impact!", 5, 5)]
    marks = spark.createDataFrame([(1, n, t, "s") for n, t in enumerate([None, "A", "", "B", "B", "A"], 1)], "k int, n int, top string, title string")
    runs = slides.chapters(marks, "k").orderBy("island").collect()
    assert [(r["chapter"], r["start"], r["end"], r["width_pct"], r["offset_pct"]) for r in runs] == [("A", 1, 3, 50.0, 0.0), ("B", 4, 5, pytest.approx(100 / 3), 50.0), ("A", 6, 6, pytest.approx(100 / 6), pytest.approx(500 / 6))]


def test_retention_and_audit(spark):
    rows = spark.createDataFrame([("a", "upload", 5, 1), ("a", "upload", 9, 2), ("a", "upload", 9, 3), ("a", "hide", 10, 4), ("b", "start", 1, 5), ("b", "other", 1, 6), ("", "upload", 1, 7), ("c", None, 1, 8)], "fileName string, action string, uploadTimestamp long, ord int")
    assert sorted(r["ord"] for r in batch.retention(rows).collect()) == [1, 3, 4, 5]
    assert tuple(batch.audit(rows).first()) == (8, 3, 2, "a,b")
    assert {r["action"]: r["n"] for r in batch.actions(rows).collect()}["unknown"] == 1


#: A report with a reachable, an unreachable and an unknown vulnerability.
OSV_REPORT = {"results": [{"source": {"path": "go.mod"}, "packages": [{
    "groups": [{"experimental_analysis": {"GO-2": {"called": True}, "GO-1": {"called": False}}}],
    "vulnerabilities": [
        {"id": "GO-2", "aliases": ["GHSA-x", "CVE-2024-2"], "summary": "two", "affected": [{"package": {"name": "stdlib"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.21.1"}]}, {"events": [{"introduced": "1.22.0"}]}], "ecosystem_specific": {"imports": [{"path": "net/http", "symbols": ["Get", "Post"]}, {"path": "net"}]}}]},
        {"id": "GO-1", "aliases": [], "affected": [{"package": {"name": ""}}, {"package": {"name": "x/net"}}]},
        {"id": "GO-3"},
    ],
}]}]}


def test_reports_and_rules(spark):
    flat = batch.osv_rows(spark.createDataFrame([(json.dumps(OSV_REPORT),)], "value string").select(F.from_json("value", batch.OSV).alias("r")).select("r.results"))
    rows = {r["go_id"]: r for r in flat.collect()}
    two = rows["GO-2"]
    assert (two["cve"], two["introduced"], two["fixed"], two["symbols"], two["called"], two["package"]) == ("CVE-2024-2", "0, 1.22.0", "1.21.1", "net/http: Get;Post | net", "true", "stdlib")
    assert (rows["GO-1"]["called"], rows["GO-1"]["package"], rows["GO-3"]["called"], rows["GO-3"]["disposition"]) == ("false", "x/net", "unknown", "verify-reachability")
    assert tuple(batch.disposition_counts(flat).first()) == (1, 1, 1)
    md = spark.createDataFrame([("x", "b.md", " B "), ("x", "INSTRUCTIONS.md", "I"), ("x", "README.md", "R"), ("x", "a.md", "A"), ("x", "c.txt", "C"), ("x", "e.md", " ")], "folder string, name string, content string")
    assert batch.rules_bundle(md).first()["bundle"] == "## INSTRUCTIONS\n\nI\n\n## a\n\nA\n\n## b\n\nB"
    lint = spark.createDataFrame([("p", "# **/**\r\nok\r\n x/**/** \n")], "path string, content string")
    assert [tuple(r) for r in batch.lint_ignore(lint).collect()] == [("p", 3, "x/**/**")]
    want = spark.createDataFrame([("rules",), ("ignore",)], "path string")
    assert [r["path"] for r in batch.missing_paths(want, want.limit(1)).collect()] == ["ignore"]


def test_navigation_wraps_for_all_small_lengths(spark):
    rows = [(f"f{n}", i, str(i)) for n in range(1, 7) for i in range(n)]
    got = {(r["file_path"], r["ord"]): (int(r["next_content"]), int(r["prev_content"])) for r in C.neighbours(spark.createDataFrame(rows, "file_path string, ord int, content string")).collect()}
    for n, i in itertools.chain.from_iterable(((n, i) for i in range(n)) for n in range(1, 7)):
        assert got[(f"f{n}", i)] == ((i + 1) % n, (i - 1) % n)


def test_all_moves_of_lists_up_to_six(spark):
    for n in range(7):
        ids = [f"c{i}" for i in range(n)]
        assert navigation.move("next", ids, -1, None, 0) == ((0, "c0", 0) if n else (-1, None, 0))
        for i in range(n):
            forward, back = navigation.move("next", ids, i, ids[i], i), navigation.move("prev", ids, i, ids[i], i)
            assert forward[1] == (ids[1:] + ids[:1])[i] and back[1] == (ids[-1:] + ids[:-1])[i]
            # The current comment goes: the next one is what has come to its place, the previous one what stands before it.
            left = ids[:i] + ids[i + 1 :]
            state = navigation.move("list", left, i, ids[i], i)
            assert state == (-1, None, min(i, len(left)))
            if left:
                assert navigation.move("next", left, *state)[1] == (left + left[:1])[i] and navigation.move("prev", left, *state)[1] == (left[-1:] + left)[i]
            # Another goes or comes before it: it stays the current one.
            assert navigation.move("list", ["new", *ids], i, ids[i], i) == (i + 1, ids[i], i + 1)
        for anchor in range(n + 1):
            assert navigation.move("list", ids, -1, None, anchor) == (-1, None, anchor)
    steps = spark.createDataFrame([(1, 3, "next", None), (1, 1, "list", ["a", "b"]), (1, 2, "next", None), (1, 4, "list", ["b"]), (1, 5, "list", None), (1, 6, "prev", None), (2, 1, "next", None)], "viewer long, seq long, kind string, ids array<string>")
    got = [tuple(r)[1:] for r in navigation.replay(steps).where("viewer = 1").orderBy("seq").collect()]
    assert got == [(1, -1, None, 0), (2, 0, "a", 0), (3, 1, "b", 1), (4, 0, "b", 0), (5, -1, None, 0), (6, -1, None, 0)]


def test_lines_are_counted_by_ranges(spark):
    """Ranges that overlap, touch, repeat or hold others; no plan makes a row for a line."""
    made = {("a", "x"): [(10, 5), (12, 1), (13, 4), (30, 2), (30, 2)], ("a", "y"): [(5, 0)], ("b", "x"): [(1, 2_000_000_000), (7, 3)], ("c", "x"): [(4, 2), (6, 1)]}
    rows = spark.createDataFrame([(k, f, (0, 0, s, n)) for (k, f), hunks in made.items() for s, n in hunks], "id string, file_path string, hunk struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int>")
    got = {(r["id"], r["file_path"]): (r["n_lines"], r["first_line"]) for r in coverage.distinct_lines(rows, "id").collect()}
    assert got == {("a", "x"): (9, 10), ("b", "x"): (2_000_000_000, 1), ("c", "x"): (3, 4)}


def test_a_task_groups_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(derived, "TASK_ROWS", 100)
    df = spark.range(1000)
    assert derived.dealt(df, "id").rdd.getNumPartitions() == 10 and derived.dealt(df, "id").count() == 1000
    assert derived.dealt(df.limit(0), "id").count() == 0
