"""All queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from . import changes, dialect, graph, history, issues, jobs, reports, reviews, streams

MODULES = (history, graph, dialect, changes, issues, reviews, jobs, reports, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
