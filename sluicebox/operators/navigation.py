"""Moving through a list of comments that changes meanwhile.

A viewer has a current comment or, where that has gone, an anchor: the place at
which the list goes on.  Forward from an anchor is the comment now at it,
backward the one before it, both around the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def move(kind: str, ids: list[str], current: int, active: str | None, anchor: int) -> tuple[int, str | None, int]:
    """The state (current, active, anchor) after a move (next, prev or list, for a list that has become ids)."""
    n = len(ids)
    if kind == "list":
        if n and active in ids:
            at = ids.index(active)
            return at, active, at
        return -1, None, min(max(anchor if current < 0 else current, 0), n)
    if not n:
        return current, active, anchor
    if kind == "next":
        at = (current + 1 if current >= 0 else anchor) % n
    else:
        at = ((current if current >= 0 else anchor) - 1) % n
    return at, ids[at], at


def replay(steps: DataFrame) -> DataFrame:
    """steps (viewer, seq, kind, ids: the list that a step of the kind list brings) with the state after each.

    A state hangs on all before it, so a viewer's steps run in order as one
    group, sorted by Spark, and hold one list at a time.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ids, state, out = [], (-1, None, 0), []
        for r in rows.sort_values("seq").itertuples():
            if r.kind == "list":
                ids = [] if r.ids is None else list(r.ids)
            state = move(r.kind, ids, *state)
            out.append((r.viewer, r.seq, *state))
        return pd.DataFrame(out, columns=["viewer", "seq", "current", "active", "anchor"])

    return steps.groupBy("viewer").applyInPandas(fold, "viewer long, seq long, current int, active string, anchor int")
