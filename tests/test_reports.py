"""Reports, attestations, tree diffs, comment shapes and coverage against plain versions and goldens."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import diff as D
from sluicebox.operators import coverage, facets, reports, slides
from sluicebox.plans import render
from sluicebox.queries import changes
from sluicebox.queries import reports as Q
from sluicebox.sources import attestations
from sluicebox.sources import sessions as store
from sluicebox.streaming import events

COMMENT = "review int, file_no int, pos int, line int, severity string, confidence string, type string, category string, subcategory string, content string"


@pytest.fixture(scope="module")
def review(spark):
    results = spark.createDataFrame([(1, "fine"), (2, "")], "review int, summary string")
    files = spark.createDataFrame([(1, 1, "a.go"), (1, 2, "b.go")], "review int, file_no int, file_path string")
    comments = spark.createDataFrame([(1, 1, 2, 8, "", "", "", "style", "", "second"), (1, 1, 1, 7, "critical", "high", "bug", "", "nil", "first\nmore")], COMMENT)
    diff = "diff --git a/a.go b/a.go\n@@ -6,2 +6,0 @@ f\n keep\n+new\n+newer\n-gone\n"
    lines = D.diff_lines(spark.createDataFrame([(1, diff)], "review int, diff string"), "review", "diff").withColumn("file_no", F.lit(1))
    return results, files, comments, lines


def test_pretty(review):
    results, files, comments, _ = review
    text = {r["review"]: r["text"] for r in reports.pretty(results, files, comments, "RESULTS").collect()}
    bar, rule = "=" * 80, "-" * 80
    assert text[1] == (
        f"\n{bar}\nRESULTS\n{bar}\n\nSummary:\nfine\n\n2 file(s) with comments:\n\n{rule}\nFILE: a.go\n{rule}\n\n  [CRITICAL] Line 7\n    Tags: confidence=high type=bug subcategory=nil\n    first\n    more\n"
        f"\n  [INFO] Line 8 (style)\n    second\n\n{rule}\nFILE: b.go\n{rule}\n  No comments for this file.\n\n{bar}\nReview complete: 2 total comment(s)\n{bar}\n\n"
    )
    assert text[2] == f"\n{bar}\nRESULTS\n{bar}\n\nNo files reviewed or no comments generated.\n"


def test_text_with_comments(review):
    results, files, comments, lines = review
    text = {r["review"]: r["text"] for r in reports.with_comments(results, files, lines, comments, "RESULTS", "now").collect()}
    bar, rule = "=" * 80, "-" * 80
    top = f"{bar}\nRESULTS - TEXT FORMAT\n{bar}\nGenerated: now\n\nSearch for '>>>COMMENT<<<' to jump between review comments\n{bar}\n\n"
    assert text[1] == (
        f"{top}SUMMARY:\nfine\n\nTOTAL FILES: 2\nTOTAL COMMENTS: 2\n\n\n{bar}\nFILE 1/2: a.go\n{bar}\n\n  2 comment(s) on this file\n\n{rule}\n@@ -6,2 +6,1 @@\n{rule}\n   6 |    6 |  keep\n".replace("|  keep", "|   keep")
        + f"     |    7 | +new\n\n>>>COMMENT<<< [CRITICAL] Line 7\n    Tags: confidence=high type=bug subcategory=nil\n{rule}\n  first\n  more\n{rule}\n\n     |    8 | +newer\n\n>>>COMMENT<<< [INFO] Line 8 (style)\n{rule}\n  second\n{rule}\n\n   7 |      | -gone\n\n"
        f"\n{bar}\nFILE 2/2: b.go\n{bar}\n\n  No comments for this file.\n\n{bar}\nEND OF REVIEW - 2 total comment(s)\n{bar}\n"
    )
    assert text[2] == f"{top}TOTAL FILES: 0\nTOTAL COMMENTS: 0\n\nNo files reviewed or no comments generated.\n\n{bar}\nEND OF REVIEW - 0 total comment(s)\n{bar}\n"


def test_json_and_shapes(spark, review):
    results, files, comments, _ = review
    got = {r["review"]: r["json"] for r in reports.as_json(results, files, comments).collect()}
    one = json.loads(got[1])
    assert [f["file_path"] for f in one["files"]] == ["a.go", "b.go"] and [c["content"] for c in one["files"][0]["comments"]] == ["first\nmore", "second"] and one["files"][1]["comments"] == []
    assert render.indented('{"a":["<"]}') == '{\n  "a": [\n    "\\u003c"\n  ]\n}\n'
    shown = reports.prepared(spark.createDataFrame([("Odd", ""), ("", "x"), ("warning", None)], "severity string, category string")).collect()
    assert [(r["severity"], r["badge"], r["has_category"]) for r in shown] == [("ODD", "badge-info", False), ("INFO", "badge-info", True), ("WARNING", "badge-warning", False)]
    full = spark.createDataFrame([([("a", [(1, 2, 3, 4, "text")])],)], "f array<struct<file_path:string,hunks:array<struct<old_start_line:int,old_line_count:int,new_start_line:int,new_line_count:int,content:string>>>>")
    assert full.select(F.to_json(reports.slim(F.col("f"))).alias("x")).first()["x"] == '[{"file_path":"a","hunks":[{"old_start_line":1,"old_line_count":2,"new_start_line":3,"new_line_count":4}]}]'
    lines = spark.createDataFrame([([" A  b", "", "a B ", "c", None, "C"],)], "x array<string>").select(reports.distinct_lines(F.col("x")).alias("x"))
    assert lines.first()["x"] == ["A  b", "c"]
    counts = lambda rows: spark.createDataFrame(rows, "file_path string, n int")
    assert [r["file_path"] for r in reports.newly_commented(counts([("a", 0), ("b", 2)]), counts([("a", 1), ("b", 3), ("c", 1), ("d", 0)])).orderBy("file_path").collect()] == ["a", "c"]


def test_comments_in_either_spelling(spark):
    made = [
        {"FilePath": "a", "Line": 3, "Content": " x ", "Severity": "WARNING", "Category": "c", "file_path": "no"},
        {"filePath": "b", "lineNumber": "4", "content": "y", "severity": "odd", "isInternal": False},
        {"file_path": "c", "line_number": 5, "content": "z"}, {"FilePath": "d", "Line": 1, "Content": "w", "IsInternal": True}, {"FilePath": "", "filePath": "e", "line": 6.0, "content": "v"},
    ]
    rows = spark.createDataFrame([("1", "batch", json.dumps({"status": "completed", "comments": made}))], "id string, type string, data string")
    assert [(r["file_path"], r["line"], r["content"], r["severity"], r["category"]) for r in events.comments(rows).orderBy("pos").collect()] == [("a", 3, "x", "warning", "c"), ("b", 4, "y", "info", "review"), ("c", 5, "z", "info", "review"), ("e", 6, "v", "info", "review")]


def test_toggled_categories_take_their_subcategories(spark):
    rows = spark.createDataFrame([(["a"], ["x"], "b", [" Y", ""]), (["a", "b"], ["x", "y"], "b", ["y"])], "c array<string>, s array<string>, v string, k array<string>")
    got = rows.select(facets.toggle_category(F.col("c"), F.col("s"), F.col("v"), F.col("k")).alias("t")).select("t.*").collect()
    assert [(r["categories"], r["subcategories"]) for r in got] == [(["a", "b"], ["x", "y"]), (["a"], ["x"])]


def test_attestations(spark, tmp_path):
    s = attestations.AttestationStore(spark, f"file://{tmp_path}/attestations")
    trees = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "tree_hash string")
    assert {r["action"] for r in s.actions(trees).collect()} == {""}
    put = lambda *rows: s.write(spark.createDataFrame(rows, "tree_hash string, payload string"))
    put(("t1", '{"action": " reviewed ", "iterations": 2}'), ("t2", "{bad"), ("t3", '{"action": "skipped"}'))
    put(("t1", '{"action": "vouched", "iterations": 3}'))
    s.remove(trees.where("tree_hash = 't3'"))
    assert {r["tree_hash"]: r["action"] for r in s.actions(trees).collect()} == {"t1": "vouched", "t2": "", "t3": "", "t4": ""}
    (one,) = s.full(trees.where("tree_hash in ('t1', 't3', 't4')")).collect()
    assert (one["tree_hash"], one["action"], one["iterations"]) == ("t1", "vouched", 3)
    with pytest.raises(Exception, match="malformed attestation"):
        s.full(trees).collect()


def test_tree_diffs(spark):
    diff = "diff --git a/x y b/x y\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +20 @@\n-b\n+c\n@@ -30,2 +31,0 @@\n-d\ndiff --git a/z b/z\n@@ -0,0 +1 @@\n+q\n"
    rows = D.changed_ranges(spark.createDataFrame([("t1", "t2", diff)], "tree1 string, tree2 string, diff string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("t1", "t2", "x y", 3, 6), ("t1", "t2", "x y", 20, 20), ("t1", "t2", "z", 1, 1)]
    names = D.tree_changes(spark.createDataFrame([("t1", "t2", "a\nb c\n\na\n")], "tree1 string, tree2 string, names string"))
    assert sorted(r["file_path"] for r in names.collect()) == ["a", "b c"]


def test_ignore_files(spark):
    assert D.ignore_lines("# c\r\n\n  \nbuild/\r\n !x \n") == ["build/", " !x "]
    paths = ["a1.txt", "ab.txt", "a!.txt", "*.md", "x.md", "lib/q.c"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    hit = lambda *patterns: [r["p"] for r in rows.where(D.ignored(F.col("p"), list(patterns))).collect()]
    assert hit("a[0-9].txt") == ["a1.txt"] and hit("a[!0-9].txt") == ["ab.txt", "a!.txt"] and hit("a[^0-9b].txt") == ["a!.txt"]
    assert hit("\\*.md") == ["*.md"] and hit("*.md", "!x.md") == ["*.md"] and hit("lib[/]q.c") == []


def test_osv_markdown_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("GO-2", "", "true", "a | b", "1.2", 'say "x", y'), ("GO-1", "CVE-1", "false", "s", "1|2", "n"), ("GO-3", "CVE-3", "unknown", "", "", "n")], "go_id string, cve string, called string, summary string, fixed string, notes string")
    rows = rows.withColumns({c: F.lit("v") for c in reports.OSV_COLUMNS if c not in rows.columns})
    lines = [r["line"] for r in reports.osv_markdown(rows, "r.json").orderBy("part", "go_id").collect()]
    assert lines[:9] == ["# OSV Triage Matrix", "", "Source report: `r.json`", "", "- Total vulnerabilities: 3", "- Called true: 1", "- Called false: 1", "- Called unknown: 1", ""]
    assert lines[-3:] == ["| GO-1 | CVE-1 | false | s | 1\\|2 | v | v |", "| GO-2 | - | true | a \\| b | 1.2 | v | v |", "| GO-3 | CVE-3 | unknown |  |  | v | v |"]
    reports.write_osv_csv(rows, f"file://{tmp_path}/csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.splitlines()[0] == ",".join(reports.OSV_COLUMNS) and '"say ""x"", y"' in text and text.splitlines()[1].startswith("GO-1,CVE-1,")


def test_event_logs_and_issue_lists(spark):
    rows = spark.createDataFrame([(1, datetime(2026, 1, 1, 9, 8, 7), "log", "hi"), (2, None, None, "there")], "seq int, time timestamp, type string, message string").withColumn("review", F.lit(1))
    assert reports.event_log(rows, "review").first()["text"] == "[1] 09:08:07 - LOG\n  hi\n\n[2]  - LOG\n  there"
    issues = spark.createDataFrame([(2, "b", 0, "two", "", "x"), (1, "a", 3, "one", "info", "x")], "ord int, file_path string, line int, content string, severity string, category string").withColumn("review", F.lit(1))
    assert reports.issue_list(issues, "review").first()["text"] == "1. a:3 — one (info, x)\n\n2. b — two"


def plain_report(doc_id, source, text):
    """The report of queries.report_with_comments for one document, line by line."""
    bar, rule, out, old, new, n = "=" * 80, "-" * 80, [], 5, 7, 0
    for i, line in enumerate((text or "").split("\n")):
        body = "|" + line.replace("\r", "")
        if i % 3 == 0:
            out.append(f"     | {new:4d} | +{body}\n")
            if new % 4 == 0:
                n += 1
                out.append(f"\n>>>COMMENT<<< [WARNING] Line {new}\n    Tags: type=bug\n{rule}\n  {body[:9]}\n{rule}\n\n")
            new += 1
        elif i % 3 == 1:
            out.append(f"{old:4d} |      | -{body}\n")
            old += 1
        else:
            out.append(f"{old:4d} | {new:4d} |   {body}\n")
            old, new = old + 1, new + 1
    own = f"\n  {n} comment(s) on this file\n\n{rule}\n@@ -5,9 +7,9 @@\n{rule}\n{''.join(out)}\n" if n else "\n  No comments for this file.\n"
    return f"{bar}\nRESULTS - TEXT FORMAT\n{bar}\nGenerated: 2026-01-01T00:00:00Z\n\nSearch for '>>>COMMENT<<<' to jump between review comments\n{bar}\n\n" + (f"SUMMARY:\n{source}\n\n" if source else "") + f"TOTAL FILES: 1\nTOTAL COMMENTS: {n}\n\n\n{bar}\nFILE 1/1: d{doc_id}\n{bar}\n{own}\n{bar}\nEND OF REVIEW - {n} total comment(s)\n{bar}\n"


def test_reports_of_documents(spark, tmp_path):
    r = random.Random(1)
    docs = [(i, "\n".join("w" * r.randrange(0, 14) for _ in range(r.randrange(1, 30))), "src" if i % 2 else "") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {x["review"]: x["text"] for x in Q.report_with_comments(spark, f"file://{tmp_path}").collect()}
    assert got == {d: plain_report(d, s, t) for d, t, s in docs}
    assert changes.document_diffs(spark, f"file://{tmp_path}").count() == 12


def test_coverage_of_random_histories(spark):
    r = random.Random(4)
    files, trees, lines = ["a", "b"], [f"t{i}" for i in range(5)], range(1, 25)
    listed = lambda entries: json.dumps([{"file_path": f, "hunks": [{"old_start_line": 0, "old_line_count": 0, "new_start_line": a, "new_line_count": n} for a, n in h]} for f, h in entries])
    for _ in range(3):
        hunks = {f: [(r.choice(lines), r.randrange(0, 6)) for _ in range(3)] for f in files}
        sessions = [(i, t, "main", r.choice(["reviewed", "reviewed", "skipped"]), "x", listed([(f, [(1, 1)]) for f in files if r.random() < 0.7]), "r") for i, t in enumerate(trees)]
        changed = [(t, "now", f) for t, f in itertools.product(trees, files) if r.random() < 0.8]
        ranges = [(t, "now", f, a, a + r.randrange(-1, 7)) for t, _, f in changed for a in r.sample(lines, 3)]
        current = [(9, "now", "main", "reviewed", "x", listed(hunks.items()), "r")]
        covered = set()
        for _, t, _, action, _, seen, _ in sessions:
            looked = {e["file_path"] for e in json.loads(seen)}
            for f, hs in hunks.items():
                for line in {x for a, n in hs for x in range(a, a + n)}:
                    new = any(q[0] == t and q[2] == f and q[3] <= line <= q[4] for q in ranges)
                    if action == "reviewed" and ((t, "now", f) not in changed or f in looked and not new):
                        covered.add((f, line))
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        got = coverage.prior_coverage(frame(sessions, store.SCHEMA), frame(current, store.SCHEMA), frame(changed, "tree1 string, tree2 string, file_path string"), frame(ranges, "tree1 string, tree2 string, file_path string, start int, `end` int")).first()
        assert got["covered_lines"] == len(covered)


def test_slides_of_sentences_and_points(spark):
    text = """# The Title

First one, e.g. This stays. Second (it is) here! "Third" at http://a.b/c. Not new... And on.
It goes on v1.2 now? 4 more `code. Here` ends. lower stays.

## Impact

- plain point. With two sentences
  carried on
* src/a-b.go:12: does a thing. Then another.
1. Risk: may fail. Or not.
2) word - no file

```
# no heading
- no item
```
> quoted
> twice

| a | b |
|---|---|
---
### Deep
tail"""
    rows = spark.createDataFrame([(1, text), (2, None), (3, "  \n"), (4, "no heading. Two")], "doc_id int, text string")
    got = [(r["doc_id"], r["n"], r["kind"], r["title"], r["top"], r["label"], r["content"]) for r in slides.slides(rows).orderBy("doc_id", "n").collect()]
    assert got == [
        (1, 1, "intro", "The Title", "", "", ""),
        (1, 2, "sentence", "", "", "", "First one, e.g. This stays."),
        (1, 3, "sentence", "", "", "", "Second (it is) here!"),
        (1, 4, "sentence", "", "", "", '"Third" at http://a.b/c. Not new... And on.'),
        (1, 5, "sentence", "", "", "", "It goes on v1.2 now?"),
        (1, 6, "sentence", "", "", "", "4 more `code. Here` ends. lower stays."),
        (1, 7, "list", "Impact", "Impact", "", "plain point. With two sentences carried on"),
        (1, 8, "file-point", "Impact", "Impact", "src/a-b.go:12", "does a thing."),
        (1, 9, "file-point", "Impact", "Impact", "src/a-b.go:12", "Then another."),
        (1, 10, "label-point", "Impact", "Impact", "Risk", "may fail."),
        (1, 11, "label-point", "Impact", "Impact", "Risk", "Or not."),
        (1, 12, "list", "Impact", "Impact", "", "word - no file"),
        (1, 13, "code", "Impact", "Impact", "", "```\n# no heading\n- no item\n```"),
        (1, 14, "block", "Impact", "Impact", "", "> quoted\n> twice"),
        (1, 15, "block", "Impact", "Impact", "", "| a | b |\n|---|---|"),
        (1, 16, "block", "Impact", "Impact", "", "---"),
        (1, 17, "sentence", "Deep", "Impact", "", "tail"),
        (4, 1, "sentence", "", "", "", "no heading."),
        (4, 2, "sentence", "", "", "", "Two"),
    ]
