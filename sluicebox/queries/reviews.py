"""Queries over event streams, decisions and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import navigation, usage
from ..sources import derived
from ..streaming import decisions, events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EVENTS = """
    e AS (
        SELECT CAST(event_id % 9000 AS VARCHAR) AS id, event_id AS seq, ts AS time, user_id AS review,
            CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'batch' WHEN 'signup' THEN 'status' WHEN 'error' THEN 'completion' ELSE 'artifact' END AS type, value FROM events)"""


def query(sql: str | None, prefix: str = EVENTS):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {prefix} {sql}" if sql.lstrip()[0] != "," else f"WITH {prefix}{sql}"
        return f

    return register


def review_events(spark: SparkSession, sf_dir: str, copies: Column | None = None) -> DataFrame:
    """Events of reviews; a tenth of the ids come twice. Batches carry a comment each, or so many copies of one."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "log", "click", "batch", "signup", "status", "error", "completion", "purchase", "artifact")])
    e = derived.table(spark, sf_dir, "events")
    comment = F.to_json(F.struct(F.lit("completed").alias("status"), F.array_repeat(F.struct(F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("file_path"), (F.col("event_id") % 40).cast("string").alias("line"), F.lit(" look ").alias("content"), F.when(F.col("event_id") % 3 == 0, "CRITICAL").otherwise("odd").alias("severity"), (F.col("event_id") % 5 == 0).alias("is_internal"), F.lit("").alias("category")), F.lit(1) if copies is None else copies).alias("comments")))
    data = F.when(F.col("event_type") == "click", comment).when(F.col("event_type") == "signup", F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, "running").otherwise("").alias("status")))).when(F.col("event_type") == "error", F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "broken").otherwise("").alias("errorSummary")))).otherwise(F.lit("{}"))
    return e.select((F.col("event_id") % 9000).cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("time"), F.col("user_id").alias("review"), kind[F.col("event_type")].alias("type"), F.lit("b").alias("batchId"), data.alias("data"))


@query("SELECT count(DISTINCT id) AS n, max(time) AS last_seen, max(time) - INTERVAL 1 SECOND AS since FROM e")
def stream_dedupe_bookmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_events(spark, sf_dir)
    n = events.deduplicate(rows).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(events.bookmark(rows))  # one row each


@query("""SELECT id, 'f' || CAST(seq % 50 AS VARCHAR) AS file_path, seq % 40 AS line, 'look' AS content, CASE WHEN seq % 3 = 0 THEN 'critical' ELSE 'info' END AS severity, 'review' AS category
    FROM e WHERE type = 'batch' AND seq % 5 <> 0 AND seq % 40 > 0""")
def stream_comments_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.comments(review_events(spark, sf_dir)).select("id", "file_path", "line", "content", "severity", "category")


@query("""SELECT r.review, coalesce(t.status, '') AS status FROM (SELECT DISTINCT review FROM e) r LEFT JOIN (
        SELECT review, arg_max(CASE WHEN type = 'status' THEN 'running' WHEN seq % 3 = 0 THEN 'failed' ELSE 'completed' END, seq) AS status FROM e WHERE (type = 'status' AND seq % 2 = 0) OR type = 'completion' GROUP BY review) t ON t.review = r.review""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.status(review_events(spark, sf_dir), "review")


_LABEL = """CASE WHEN ms >= 3600000 - 500 THEN CAST((ms + 500) // 3600000 AS VARCHAR) || 'h' || CASE WHEN (ms + 500) % 3600000 // 60000 > 0 THEN ' ' || CAST((ms + 500) % 3600000 // 60000 AS VARCHAR) || 'm' ELSE '' END
    WHEN ms >= 60000 - 500 THEN CAST((ms + 500) // 60000 AS VARCHAR) || 'm' || CASE WHEN (ms + 500) % 60000 // 1000 > 0 THEN ' ' || CAST((ms + 500) % 60000 // 1000 AS VARCHAR) || 's' ELSE '' END ELSE CAST((ms + 500) // 1000 AS VARCHAR) || 's' END"""


@query(f""", c AS (SELECT *, epoch_us(time) // 1000 AS at_ms, CASE WHEN type = 'batch' AND seq % 5 <> 0 AND seq % 40 > 0 THEN seq % 3 ELSE 0 END AS n FROM e),
    t AS (SELECT review, min(at_ms) AS base, max(at_ms) AS last, min(CASE WHEN n > 0 THEN at_ms END) AS first, min(CASE WHEN type = 'completion' THEN at_ms END) AS done, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY review),
    f AS (SELECT *, first - base AS ms FROM t)
    SELECT review, greatest(coalesce(done, last) - base, 0) AS elapsed_ms, ms AS first_comment_ms, CASE WHEN ms IS NOT NULL THEN {_LABEL} WHEN done IS NOT NULL THEN 'No comments' ELSE 'Waiting' END AS first_comment, n AS total_comments FROM f""")
def performance_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose batches carry no comment, one or two."""
    return events.performance(review_events(spark, sf_dir, (F.col("event_id") % 3).cast("int")), "review")


@query("""SELECT seq, CASE WHEN ms >= 3600000 THEN CAST(ms // 3600000 AS VARCHAR) || 'h' || CASE WHEN ms % 3600000 // 60000 > 0 THEN ' ' || CAST(ms % 3600000 // 60000 AS VARCHAR) || 'm' ELSE '' END
        WHEN ms >= 60000 THEN CAST(ms // 60000 AS VARCHAR) || 'm' || CASE WHEN ms % 60000 // 1000 > 0 THEN ' ' || CAST(ms % 60000 // 1000 AS VARCHAR) || 's' ELSE '' END ELSE CAST(ms // 1000 AS VARCHAR) || 's' END AS label,
        ms // 3000 % 4 AS line_no FROM (SELECT seq, seq * 1000 AS ms FROM e) t""")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("seq") * 1000
    return review_events(spark, sf_dir).select("seq", X.duration(ms).alias("label"), (F.array_position(F.array(*[F.lit(x) for x in events.LOADING]), events.loading_line(ms)) - 1).alias("line_no"))


_DECISIONS = """
    s AS (
        SELECT conv_id AS scenario_id, turn AS seq, CASE WHEN role = 'system' OR turn % 4 = 2 THEN 'poll' ELSE 'decision' END AS event, CASE role WHEN 'user' THEN 'web' ELSE 'terminal' END AS source,
            CASE turn % 5 WHEN 3 THEN 5 ELSE CAST(turn % 5 AS INTEGER) END AS code, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS message, conv_id % 3 = 0 AS start_complete, conv_id % 2 = 0 AS precommit, turn % 7 = 0 AS push FROM conversations),
    p AS (SELECT *, start_complete OR coalesce(bool_or(event = 'poll') OVER (PARTITION BY scenario_id ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS complete FROM s),
    d AS (SELECT *, code = 1 OR (code IN (2, 4) AND NOT complete) OR (code IN (0, 5) AND complete) AS allowed FROM p WHERE event = 'decision'),
    v AS (SELECT *, allowed AND NOT (source = 'web' AND code = 0 AND message = '') AS valid FROM d),
    w AS (SELECT *, min(CASE WHEN valid THEN seq END) OVER (PARTITION BY scenario_id) AS won FROM v),
    o AS (SELECT *, CASE WHEN seq = won THEN 'accepted' WHEN seq > won THEN 'already-resolved' WHEN NOT allowed THEN 'invalid-phase' ELSE 'empty-web-message' END AS outcome FROM w)"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision events: a scenario for each conversation."""
    c = derived.table(spark, sf_dir, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("conv_id").alias("scenario_id"),
        t.alias("seq"),
        F.when((F.col("role") == "system") | (t % 4 == 2), "poll").otherwise("decision").alias("event"),
        F.when(F.col("role") == "user", "web").otherwise("terminal").alias("source"),
        F.when(t % 5 == 3, 5).otherwise((t % 5).cast("int")).alias("code"),
        F.when(t % 2 == 0, "").otherwise(F.col("text")).alias("message"),
        (F.col("conv_id") % 3 == 0).alias("start_complete"),
        (F.col("conv_id") % 2 == 0).alias("precommit"),
        (t % 7 == 0).alias("push"),
        F.lit("first").alias("initial_message"),
        F.when(F.col("conv_id") % 5 == 0, "edited").otherwise("").alias("editor_message"),
    )


@query("SELECT scenario_id, seq, code, source, outcome FROM o", _DECISIONS)
def decision_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.outcomes(scenarios(spark, sf_dir)).select("scenario_id", "seq", "code", "source", "outcome")


@query("SELECT scenario_id, seq, code, source, outcome FROM o", _DECISIONS.replace("(code IN (2, 4) AND NOT complete)", "code IN (2, 4)"))
def decision_late_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as the runtime takes them: skip and vouch after completion too."""
    return decisions.outcomes(scenarios(spark, sf_dir), late_skip=True).select("scenario_id", "seq", "code", "source", "outcome")


@query("""SELECT scenario_id, code AS decision_code, CASE WHEN code = 1 THEN 1 WHEN precommit AND code IN (2, 4) THEN 2 ELSE 0 END AS exit_code, code = 0 AS committed, code = 1 AS aborted, code = 2 AS skipped, code = 4 AS vouched,
        m AS final_message, push AS push_requested, precommit AND code = 0 AND push AS push_marker, CASE WHEN precommit AND code = 0 THEN m ELSE '' END AS override
    FROM (SELECT *, CASE WHEN code = 0 THEN coalesce(CASE WHEN source = 'web' THEN nullif(message, '') END, CASE WHEN scenario_id % 5 = 0 THEN 'edited' END, nullif(message, ''), 'first') WHEN code IN (2, 4) THEN message ELSE '' END AS m FROM o WHERE outcome = 'accepted') t""", _DECISIONS)
def decision_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.results(scenarios(spark, sf_dir))


def draft_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 6 == 5, "freeze").otherwise("update").alias("kind"), F.col("text"), (F.col("turn") % 3).alias("expected"))
    return decisions.draft_updates(rows)


QUERIES["draft_register"] = draft_register
ORACLES["draft_register"] = """WITH RECURSIVE
    r AS (SELECT conv_id AS draft_id, turn AS seq, turn % 6 = 5 AS stops, turn % 3 AS expected, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (
        SELECT draft_id, k, seq, CASE WHEN stops THEN 'frozen' ELSE 'accepted' END AS result, CASE WHEN stops THEN 0 ELSE 1 END AS version, stops AS frozen FROM r WHERE k = 1
        UNION ALL SELECT r.draft_id, r.k, r.seq, CASE WHEN stops THEN 'frozen' WHEN f.frozen THEN 'refused-frozen' WHEN 0 < expected AND expected < version THEN 'refused-stale' ELSE 'accepted' END,
            CASE WHEN stops OR f.frozen OR (0 < expected AND expected < version) THEN version ELSE version + 1 END, f.frozen OR stops FROM f JOIN r ON r.draft_id = f.draft_id AND r.k = f.k + 1)
    SELECT draft_id, seq, result, CAST(version AS BIGINT) AS version FROM f"""


@query("""SELECT scenario_id, CASE WHEN decided IS NOT NULL AND (polled IS NULL OR decided <= polled + 300) THEN 'decision' ELSE 'poll' END AS winner FROM (
    SELECT scenario_id, min(CASE WHEN event = 'decision' THEN seq * 250 END) AS decided, min(CASE WHEN event = 'poll' THEN seq * 250 END) AS polled FROM s GROUP BY scenario_id) t""", _DECISIONS)
def decision_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios(spark, sf_dir).withColumn("ms", F.col("seq") * 250)
    return decisions.grace(rows.where("event = 'decision'"), rows.where("event = 'poll'"))


@query("""SELECT n_nationkey AS org_id, CASE WHEN n_nationkey % 3 = 0 THEN 'loc_200k' WHEN n_nationkey % 3 = 1 THEN 'team_32usd' ELSE 'free_30k' END AS plan_code, used AS loc_used,
        CASE WHEN n_nationkey % 3 = 0 THEN 250000 WHEN n_nationkey % 3 = 1 THEN 100000 ELSE 30000 END AS loc_limit,
        least(used * 100 // CASE WHEN n_nationkey % 3 = 0 THEN 250000 WHEN n_nationkey % 3 = 1 THEN 100000 ELSE 30000 END, 100) AS usage_pct, CASE WHEN n_nationkey % 3 = 0 THEN '2026-02-01' ELSE '' END AS reset_at, true AS available
    FROM (SELECT n_nationkey, CAST(coalesce(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)), 0) AS BIGINT) AS used FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey) u""", "zero AS (SELECT 0)")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the organisations have billing data, all a quota, and the plan's name comes from each source in turn."""
    nation, customer, orders = (derived.table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    orgs = nation.select(F.col("n_nationkey").alias("org_id"))
    spent = customer.join(orders, customer["c_custkey"] == orders["o_custkey"]).groupBy(F.col("c_nationkey").alias("org_id")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("used"))
    third = F.col("org_id") % 3
    text = lambda x: F.lit(x).cast("string")
    quota = orgs.join(spent, "org_id", "left").select("org_id", F.when(third == 0, " free_30k ").alias("plan_code"), F.when(third == 1, "Team").otherwise(text(None)).alias("plan_type"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.lit(0).cast("long").alias("quota_limit"), F.lit(None).cast("int").alias("pct"), text("").alias("reset_at"), F.lit(False).alias("blocked"))
    billing = orgs.where(third == 0).select("org_id", F.lit("loc_200k ").alias("plan_code"), F.lit(7).cast("long").alias("used"), F.lit("2026-02-01").alias("period_end"))
    plans = spark.createDataFrame([("loc_200k", 250000), ("free_30k", 1)], "plan_code string, monthly_limit long")
    subscription = orgs.select("org_id", F.lit("free").alias("plan_type"))
    return usage.merge(orgs, quota, billing, plans, subscription)


@query("""SELECT org_id, member_id, loc, label, place FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY loc DESC, member_id) AS place FROM (
        SELECT c_nationkey AS org_id, c_custkey AS member_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS loc, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 'System' ELSE 'Unknown' END ELSE c_name END AS label
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey, c_name) t) r WHERE place <= 3""", "zero AS (SELECT 0)")
def usage_top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = derived.table(spark, sf_dir, "customer"), derived.table(spark, sf_dir, "orders")
    # Orders are summed by customer before names are joined to them.
    sums = orders.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("loc"))
    rows = customer.join(sums, customer["c_custkey"] == sums["o_custkey"]).select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("member_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("email"), F.when(F.col("c_custkey") % 8 == 0, " SYSTEM ").otherwise("user").alias("kind"), "loc")
    return usage.top_members(rows).select("org_id", "member_id", "loc", "label", "place")


@query("""SELECT seq, type, CASE type WHEN 'log' THEN '' WHEN 'batch' THEN CASE WHEN seq % 4 = 0 THEN 'Batch b started: processing ' || CAST(seq % 3 AS VARCHAR) || CASE WHEN seq % 3 = 1 THEN ' file' ELSE ' files' END
            WHEN seq % 4 = 1 THEN 'Batch b completed: generated ' || CAST(seq % 3 AS VARCHAR) || CASE WHEN seq % 3 = 1 THEN ' comment' ELSE ' comments' END WHEN seq % 4 = 2 THEN 'Batch b: pending' ELSE 'Batch b: unknown status' END
        WHEN 'status' THEN CASE WHEN seq % 2 = 0 THEN 'Status: running' ELSE 'Status: unknown' END WHEN 'artifact' THEN CASE WHEN seq % 2 = 0 THEN 'Generated: artifact' ELSE 'Artifact: unknown' END
        ELSE CASE WHEN seq % 3 = 0 THEN 'all done' ELSE 'Process completed with ' || CAST(seq % 2 AS VARCHAR) || CASE WHEN seq % 2 = 1 THEN ' comment' ELSE ' comments' END END END AS message FROM e""")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's line of the log; the events' data vary by their number."""
    n = F.col("seq")
    data = F.struct(
        F.element_at(F.array(F.lit("processing"), F.lit("completed"), F.lit("pending"), F.lit("")), (n % 4 + 1).cast("int")).alias("batch_status"),
        F.when(n % 2 == 0, "running").otherwise("").alias("status"),
    )
    status = F.when(F.col("type") == "batch", data["batch_status"]).otherwise(data["status"])
    count = F.when(F.col("type") == "completion", n % 2).otherwise(n % 3)
    made = F.to_json(F.struct(status.alias("status"), (n % 3).alias("fileCount"), count.alias("commentCount"), F.when(n % 2 == 0, "u").alias("url"), F.when((F.col("type") == "completion") & (n % 3 == 0), "all done").alias("resultSummary")))
    return events.message(review_events(spark, sf_dir).withColumn("data", made)).select("seq", "type", "message")


@query("""SELECT review, seq FROM (SELECT review, seq, row_number() OVER (PARTITION BY review ORDER BY time DESC, seq DESC) AS k FROM e) t WHERE k = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("review").orderBy(F.desc("time"), F.desc("seq"))
    return review_events(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("review", "seq")


def comment_nav_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewers who move through lists of comments that grow, shrink and lose the one they look at."""
    c = derived.table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    ids = F.expr("filter(transform(sequence(0, 6), i -> concat('c', i)), (c, i) -> i < (conv_id + turn) % 7 AND i <> turn % 5)")
    return navigation.replay(c.select(F.col("conv_id").alias("viewer"), turn.alias("seq"), F.when(turn % 3 == 0, "list").when(turn % 3 == 1, "next").otherwise("prev").alias("kind"), F.when(turn % 3 == 0, ids).alias("ids")))


QUERIES["comment_nav_replay"] = comment_nav_replay
ORACLES["comment_nav_replay"] = """WITH RECURSIVE
    r AS (SELECT conv_id AS viewer, turn AS seq, turn % 3 AS kind, [('c' || i) FOR i IN range(0, 7) IF i < (conv_id + turn) % 7 AND i <> turn % 5] AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (
        SELECT DISTINCT viewer, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, -1 AS current, CAST(NULL AS VARCHAR) AS active, 0 AS anchor, CAST([] AS VARCHAR[]) AS ids FROM r
        UNION ALL
        SELECT viewer, k, seq, CAST(CASE WHEN kind = 0 THEN coalesce(nullif(list_position(n_ids, active), 0), 0) - 1 WHEN len(n_ids) = 0 THEN current ELSE place END AS INTEGER),
            CASE WHEN kind = 0 THEN CASE WHEN list_contains(n_ids, active) THEN active END WHEN len(n_ids) = 0 THEN active ELSE n_ids[place + 1] END,
            CAST(CASE WHEN kind = 0 THEN CASE WHEN list_contains(n_ids, active) THEN list_position(n_ids, active) - 1 ELSE least(greatest(CASE WHEN current < 0 THEN anchor ELSE current END, 0), len(n_ids)) END WHEN len(n_ids) = 0 THEN anchor ELSE place END AS INTEGER), n_ids
        FROM (SELECT *, CASE WHEN kind = 1 THEN (CASE WHEN current >= 0 THEN current + 1 ELSE anchor END) % greatest(len(n_ids), 1) ELSE ((CASE WHEN current >= 0 THEN current ELSE anchor END) - 1 + len(n_ids)) % greatest(len(n_ids), 1) END AS place
            FROM (SELECT r.viewer, r.k, r.seq, r.kind, CASE WHEN r.kind = 0 THEN r.ids ELSE f.ids END AS n_ids, f.current, f.active, f.anchor FROM f JOIN r ON r.viewer = f.viewer AND r.k = f.k + 1) a) b)
    SELECT viewer, seq, current, active, anchor FROM f WHERE k > 0"""
