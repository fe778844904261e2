"""First valid decision wins: review decisions arbitrated in order, and versioned drafts.

In batch the phase of a review is a running maximum over its events and the
winner is its first valid decision; on a stream the same rules run as keyed
state, which is all that arrival order needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Codes of decisions.
COMMIT, ABORT, SKIP, VOUCH, HANDOFF = 0, 1, 2, 4, 5


def allowed(code: Column, complete: Column, late_skip: bool = False) -> Column:
    """Whether a decision may be made in a phase: skip and vouch while a review runs (with late_skip after it too), commit and handoff after, abort always."""
    return (code == ABORT) | (code.isin(SKIP, VOUCH) & (F.lit(late_skip) | ~complete)) | (code.isin(COMMIT, HANDOFF) & complete)


def running_phase(events: DataFrame, key: str = "scenario_id") -> DataFrame:
    """events (event: poll or decision) with complete: whether the review was complete when each came."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("complete", F.col("start_complete") | F.coalesce(F.max(F.col("event") == "poll").over(before), F.lit(False)))


def outcomes(events: DataFrame, key: str = "scenario_id", late_skip: bool = False) -> DataFrame:
    """Each decision with whether it is accepted, and why not; the runtime that arbitrates takes skip and vouch late, a request's check does not."""
    rows = running_phase(events, key).where("event = 'decision'")
    empty = (F.col("source") == "web") & (F.col("code") == COMMIT) & (F.coalesce("message", F.lit("")) == "")
    may = allowed(F.col("code"), F.col("complete"), late_skip)
    valid = may & ~empty
    first = F.min(F.when(F.col("valid"), F.col("seq"))).over(Window.partitionBy(key))
    rows = rows.withColumn("valid", valid).withColumn("won_at", first)
    reason = F.when(F.col("seq") == F.col("won_at"), "accepted").when(F.col("seq") > F.col("won_at"), "already-resolved").when(~may, "invalid-phase").otherwise("empty-web-message")
    return rows.withColumn("outcome", reason).drop("valid", "won_at")


def final_message() -> Column:
    """The web's message, else the editor's, else the decision's, else the first one."""
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    return F.coalesce(F.when(F.col("source") == "web", some("message")), some("editor_message"), some("message"), some("initial_message"), F.lit(""))


def results(events: DataFrame, key: str = "scenario_id", late_skip: bool = False) -> DataFrame:
    """What each scenario comes to: code, exit code, flags, message and push marks."""
    won = outcomes(events, key, late_skip).where("outcome = 'accepted'")
    code, pre = F.col("code"), F.col("precommit")
    message = F.when(code == COMMIT, final_message()).when(code.isin(SKIP, VOUCH), F.coalesce("message", F.lit(""))).otherwise(F.lit(""))
    exit_code = F.when(code == ABORT, F.lit(ABORT)).when(pre & code.isin(SKIP, VOUCH), F.lit(SKIP)).otherwise(F.lit(0))
    push = F.coalesce("push", F.lit(False))
    return won.select(
        key,
        code.alias("decision_code"),
        exit_code.alias("exit_code"),
        (code == COMMIT).alias("committed"),
        (code == ABORT).alias("aborted"),
        (code == SKIP).alias("skipped"),
        (code == VOUCH).alias("vouched"),
        message.alias("final_message"),
        push.alias("push_requested"),
        (pre & (code == COMMIT) & push).alias("push_marker"),
        F.when(pre & (code == COMMIT), message).otherwise(F.lit("")).alias("override"),
    )


def web_status(method: Column, path: Column, code: Column, complete: Column, message: Column) -> Column:
    """The HTTP status of a decision sent over the web."""
    return F.when(method != "POST", F.lit(405)).when(~path.isin("/commit", "/commit-push", "/skip", "/vouch", "/abort"), F.lit(404)).when(~allowed(code, complete), F.lit(409)).when((code == COMMIT) & (F.trim(message) == ""), F.lit(400)).otherwise(F.lit(200))


def grace(decisions: DataFrame, polls: DataFrame, key: str = "scenario_id", ms: int = 300) -> DataFrame:
    """Which of a review's first decision and its poll result counts: a decision up to ``ms`` after the poll does."""
    d = decisions.groupBy(key).agg(F.min("ms").alias("decided"))
    p = polls.groupBy(key).agg(F.min("ms").alias("polled"))
    return d.join(p, key, "full").select(key, F.when(F.col("decided").isNotNull() & (F.col("polled").isNull() | (F.col("decided") <= F.col("polled") + ms)), "decision").otherwise("poll").alias("winner"))


def stream_decisions(events: DataFrame, late_skip: bool = False) -> DataFrame:
    """The accepted decision of each scenario, as its events arrive (scenario_id, seq, event, code, source, message, start_complete)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        complete, done = state.get if state.exists else (None, False)
        for rows in batches:
            for r in rows.sort_values("seq").itertuples():
                complete = bool(r.start_complete) if complete is None else complete
                if r.event == "poll":
                    complete = True
                elif not done and (r.code == ABORT or (r.code in (SKIP, VOUCH) and (late_skip or not complete)) or (r.code in (COMMIT, HANDOFF) and complete and not (r.code == COMMIT and r.source == "web" and not r.message))):
                    done = True
                    yield pd.DataFrame({"scenario_id": [key[0]], "seq": [r.seq], "code": [r.code]})
        state.update((bool(complete), done))

    return events.groupBy("scenario_id").applyInPandasWithState(step, "scenario_id long, seq long, code int", "complete boolean, done boolean", "append", GroupStateTimeout.NoTimeout)


def draft_updates(rows: DataFrame) -> DataFrame:
    """Updates of versioned drafts (draft_id, seq, kind: update or freeze, text, expected) with what becomes of each.

    An update is refused once the draft is frozen, or if it expects an earlier
    version than there is.  Whether one is accepted depends on all before it, so
    a draft's updates run in order as one group: sorted by Spark, with three
    values of state.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        version, frozen, out = 0, False, []
        for r in pdf.sort_values("seq").itertuples():
            if r.kind == "freeze":
                frozen, result = True, "frozen"
            elif frozen:
                result = "refused-frozen"
            elif 0 < r.expected < version:
                result = "refused-stale"
            else:
                version, result = version + 1, "accepted"
            out.append((r.draft_id, r.seq, result, version))
        return pd.DataFrame(out, columns=["draft_id", "seq", "result", "version"])

    return rows.groupBy("draft_id").applyInPandas(fold, "draft_id long, seq long, result string, version long")
