"""The entry without the optional parts, and decisions against a plain run of every short scenario."""

import itertools
import sys

import __spark_entry__ as entry

from sluicebox.streaming import decisions

EVENTS = "scenario_id long, seq long, event string, source string, code int, message string, start_complete boolean, precommit boolean, push boolean, initial_message string, editor_message string"


def test_core_queries_stay_where_a_library_is_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = entry.queries()
    assert "alias_stats" in found and "pipeline" not in found and not [n for n in found if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(found)


def plain(complete, precommit, editor, steps):
    """(code, exit code, message, push mark, override) of a scenario, step by step."""
    for s in steps:
        if s is None:
            complete = True
            continue
        source, code, message, push = s
        fits = code == 1 or (not complete and code in (2, 4)) or (complete and code in (0, 5))
        if not fits or (source == "web" and code == 0 and not message):
            continue
        text = ""
        if code == 0:
            text = (message if source == "web" else "") or editor or message or "first"
        elif code in (2, 4):
            text = message
        left = 1 if code == 1 else 2 if precommit and code in (2, 4) else 0
        return code, left, text, bool(precommit and code == 0 and push), text if precommit and code == 0 else ""
    return None


def test_every_short_scenario(spark):
    steps = [None, ("web", 0, "", False), ("web", 0, "m", True), ("terminal", 0, "", False), ("terminal", 0, "t", True), ("web", 1, "", False), ("terminal", 2, "s", False), ("web", 4, "v", False), ("terminal", 5, "", False)]
    made = [(c, p, e, s) for c, p, e in itertools.product((True, False), (True, False), ("", "ed")) for n in (1, 2) for s in itertools.product(steps, repeat=n)]
    made += [(False, True, "", s) for s in itertools.product(steps, repeat=3)]
    rows = []
    for i, (complete, precommit, editor, scenario) in enumerate(made):
        for k, s in enumerate(scenario):
            rows.append((i, k, "poll" if s is None else "decision", s and s[0], s and s[1], s and s[2], complete, precommit, s and s[3], "first", editor))
    got = {r["scenario_id"]: (r["decision_code"], r["exit_code"], r["final_message"], r["push_marker"], r["override"]) for r in decisions.results(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {i: e for i, m in enumerate(made) if (e := plain(*m))}
