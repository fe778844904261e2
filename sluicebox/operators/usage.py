"""Usage of organisations, merged from several sources by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip

#: Short plan names, and lines of code that plans include.
PLAN_NAMES = {"free": "free_30k", "team": "team_32usd"}
PLAN_LIMITS = {"free_30k": 30000, "team_32usd": 100000, "loc_100k": 100000, "loc_200k": 200000, "loc_400k": 400000, "loc_800k": 800000, "loc_1600k": 1600000, "loc_3200k": 3200000}


def plan_code(c: Column) -> Column:
    p = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = p
    for short, code in PLAN_NAMES.items():
        out = F.when(p == short, code).otherwise(out)
    return out


def plan_limit(c: Column) -> Column:
    out = F.lit(0)
    for code, n in PLAN_LIMITS.items():
        out = F.when(plan_code(c) == code, n).otherwise(out)
    return out.cast("long")


def clamp_pct(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(100))


def merge(orgs: DataFrame, quota: DataFrame, billing: DataFrame, plans: DataFrame, subscription: DataFrame) -> DataFrame:
    """One row for each organisation.

    quota: org_id, plan_code, plan_type, used, quota_limit, pct, reset_at, blocked;
    billing: org_id, plan_code, used, period_end; plans: plan_code, monthly_limit;
    subscription: org_id, plan_type.  Billing goes before quota for plan and
    reset, quota before billing for lines used; the plan's own limit goes before all.
    """
    q = quota.select("org_id", *[F.col(c).alias(f"q_{c}") for c in quota.columns if c != "org_id"], F.lit(True).alias("has_q"))
    b = billing.select("org_id", *[F.col(c).alias(f"b_{c}") for c in billing.columns if c != "org_id"], F.lit(True).alias("has_b"))
    s = subscription.select("org_id", F.col("plan_type").alias("s_plan_type"), F.lit(True).alias("has_s"))
    rows = orgs.join(q, "org_id", "left").join(b, "org_id", "left").join(s, "org_id", "left")
    code = F.coalesce(blank_to_null("b_plan_code"), blank_to_null("q_plan_code"), F.lit(""))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("given", code).withColumn("used", F.coalesce(F.nullif("q_used", zero), "b_used", zero))
    first = plans.groupBy(strip("plan_code").alias("given")).agg(F.min("monthly_limit").alias("p_limit"))
    rows = rows.join(first, "given", "left")
    plan = F.coalesce(F.nullif("given", F.lit("")), F.nullif(plan_code(F.col("q_plan_type")), F.lit("")), F.nullif(plan_code(F.col("s_plan_type")), F.lit("")), F.lit(""))
    rows = rows.withColumn("plan_code", plan)
    own = F.coalesce(F.when(F.col("has_b"), F.col("p_limit")), "q_quota_limit", zero)
    rows = rows.withColumn("loc_limit", F.when(own == 0, plan_limit(F.col("plan_code"))).otherwise(own))
    pct = F.when(F.col("loc_limit") > 0, clamp_pct(F.expr("used * 100 div nullif(loc_limit, 0)"))).otherwise(F.coalesce(clamp_pct(F.col("q_pct")), F.lit(0)))
    reset = F.coalesce(blank_to_null("b_period_end"), blank_to_null("q_reset_at"), F.lit(""))
    rows = rows.withColumn("usage_pct", pct.cast("long")).withColumn("reset_at", reset)
    signal = (F.col("plan_code") != "") | (F.col("reset_at") != "") | (F.col("loc_limit") > 0) | (F.col("used") > 0) | (F.col("usage_pct") > 0)
    any_ = F.coalesce("has_q", "has_b", "has_s", F.lit(False))
    return rows.select("org_id", "plan_code", F.col("used").alias("loc_used"), "loc_limit", "usage_pct", "reset_at", (any_ & signal).alias("available"))


def top_members(members: DataFrame, n: int = 3) -> DataFrame:
    """The n members of each organisation with the most lines (ties by member id)."""
    label = F.coalesce(blank_to_null("email"), F.when(F.lower(strip("kind")) == "system", "System").otherwise("Unknown"))
    place = F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc("loc"), "member_id"))
    return members.withColumn("label", label).withColumn("place", place).where(F.col("place") <= n)


def tone(pct: Column, blocked: Column) -> Column:
    return F.when(blocked | (pct >= 100), "danger").when(pct >= 80, "warning").otherwise("ok")
