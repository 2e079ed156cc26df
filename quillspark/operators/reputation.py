"""Reputation of agents in roles, from steps of runs, and what follows from it for a flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n


def ledger(steps: DataFrame, min_runs: int = 1) -> DataFrame:
    """role, agent, runs, successes, rate, Wilson bound, mean duration, numbers by status, last run, first fingerprint.

    ``steps``: role, agent, status, ok, duration_ms, at, ord, fingerprint."""
    keys = ["role", "agent"]
    by_status = steps.groupBy(*keys, "status").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "c")))).alias("statuses"))
    first = F.min(F.when(F.col("fingerprint").isNotNull(), F.struct("ord", "fingerprint")))["fingerprint"]
    sums = steps.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.sum(F.col("ok").cast("long")).alias("successes"),
        F.avg("duration_ms").alias("mean_duration_ms"), F.max("at").alias("last_at"), first.alias("fingerprint"),
    )
    rows = sums.where(F.col("runs") >= min_runs).join(by_status, keys)
    return rows.withColumn("success_rate", F.col("successes") / F.col("runs")).withColumn(
        "wilson", n.wilson(F.col("successes"), F.col("runs")),
    ).withColumn("confidence", n.confidence(F.col("runs")))


def best_by_role(entries: DataFrame) -> DataFrame:
    """Each role's best agent: Wilson's bound, then more runs, then the shorter mean duration, then the name."""
    order = [F.desc("wilson"), F.desc("runs"), F.asc_nulls_last("mean_duration_ms"), F.asc("agent")]
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy("role").orderBy(*order))).where("_n = 1").drop("_n")


def direct_activity(events: DataFrame, since: str, until: str) -> DataFrame:
    """provider, sessions, calls, cost, cost per session, last time."""
    rows = events.where(F.col("ts").between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    sums = rows.groupBy(F.col("provider_norm").alias("provider")).agg(
        F.count_distinct(n.blank_to_null(F.col("session_id"))).alias("sessions"),
        F.sum(1 - F.col("is_correction")).alias("calls"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"), F.max("ts").alias("last_ts"),
    )
    return sums.withColumn("cost_per_session", F.coalesce(F.try_divide("cost", F.nullif(F.col("sessions"), F.lit(0))), F.lit(0.0)))


def failure_modes(steps: DataFrame, most: int = 3) -> DataFrame:
    """agent, status, failures: each agent's most common statuses of failed steps."""
    counts = steps.where(~F.col("ok")).groupBy("agent", "status").agg(F.count("*").alias("failures"))
    w = Window.partitionBy("agent").orderBy(F.desc("failures"), "status")
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def cards(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """agent, runs, successes, roles, last time, success rate and the three most common failures: one card for each agent."""
    sums = entries.groupBy("agent").agg(
        F.sum("runs").alias("runs"), F.sum("successes").alias("successes"), F.count("*").alias("roles"),
        F.max("last_at").alias("last_at"),
    )
    modes = failure_modes(steps).groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(":", "status", F.col("failures").cast("string")).alias("t")))).alias("m"))
    return sums.withColumn("success_rate", F.col("successes") / F.col("runs")).join(
        modes.select("agent", F.array_join(F.transform("m", lambda x: x["t"]), ",").alias("failures")), "agent", "left",
    )


def route(flow: DataFrame, entries: DataFrame, threshold: float = 0.7, min_runs: int = 5, timeouts: float = 0.2) -> DataFrame:
    """flow_id, ord, role, agent, risk, action for each step of a flow (flow_id, ord, role, agent), in the order of ord, then
    of role and agent.

    A risky step without a reviewer next gets one, unless the step before it just did; a safe step's reviewer goes. So of
    risky steps in a row every second one gets a reviewer, from the first."""
    best = entries.groupBy("role", "agent").agg(F.max_by(F.struct("runs", "success_rate", "statuses"), "runs").alias("e"))
    best = best.select("role", "agent", "e.runs", "e.success_rate", F.coalesce(F.try_element_at("e.statuses", F.lit("timeout")), F.lit(0)).alias("timeouts"))
    runs = F.coalesce("runs", F.lit(0))
    risk = (
        F.when(runs < max(min_runs, 1), "MED")
        .when(F.col("success_rate") < threshold, "HIGH")
        .when((F.col("timeouts") >= 1) & (F.col("timeouts") / runs >= timeouts), "MED")
        .otherwise("LOW")
    )
    order = ["ord", "role", "agent"]
    w = Window.partitionBy("flow_id").orderBy(*order)
    rows = flow.join(best, ["role", "agent"], "left").withColumn("risk", risk).withColumn("_next", F.lead("role").over(w).eqNullSafe(F.lit("reviewer")))
    own = ~F.col("role").eqNullSafe(F.lit("reviewer"))
    rows = rows.withColumn("_ask", own & (F.col("risk") != "LOW") & ~F.col("_next"))
    rows = rows.withColumn("_row", F.sum((~F.col("_ask")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.col("_ask").cast("long")).over(Window.partitionBy("flow_id", "_row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    trim = own & (F.col("risk") == "LOW") & F.col("_next")
    action = F.when(F.col("_ask") & (nth % 2 == 1), "inject_reviewer").when(trim, "trim_reviewer").otherwise("keep")
    return rows.select("flow_id", "ord", "role", "agent", "risk", action.alias("action"))


def apply_route(decisions: DataFrame) -> DataFrame:
    """flow_id, ord, role: the new flow; an added reviewer has the step's number and a half."""
    trimmed = F.lag("action").over(Window.partitionBy("flow_id").orderBy("ord")).eqNullSafe(F.lit("trim_reviewer"))
    kept = decisions.withColumn("_gone", trimmed).where("not _gone")
    added = kept.where("action = 'inject_reviewer'").select("flow_id", (F.col("ord") + 0.5).alias("ord"), F.lit("reviewer").alias("role"))
    return kept.select("flow_id", F.col("ord").cast("double").alias("ord"), "role").unionByName(added)


def role_changes(best: DataFrame, current: DataFrame) -> DataFrame:
    """role, action, agent: which roles should change hands. ``current``: role, agent."""
    joined = current.select("role", F.col("agent").alias("now")).join(best.select("role", "agent", "confidence"), "role", "full")
    action = F.when(F.col("agent").isNull(), "keep").when(F.col("now").isNull(), "add").when(F.col("now") == F.col("agent"), "keep").otherwise("change")
    return joined.select("role", action.alias("action"), F.coalesce("agent", "now").alias("agent"), "confidence")


def latest_claims(comments: DataFrame, now: str, grace: float = 1.0) -> DataFrame:
    """issue, claim, expired: of each issue's latest claim or heartbeat, whether its lease has run out.

    ``comments``: issue, id, at, kind (claim or heartbeat), exec_id, lease_seconds."""
    last = comments.groupBy("issue").agg(F.max_by(F.struct("exec_id", "at", "lease_seconds"), F.struct("at", "id")).alias("c"))
    late = F.timestamp_diff("SECOND", F.col("c.at"), F.lit(now).cast("timestamp_ntz")) > F.col("c.lease_seconds") * grace
    return last.select("issue", F.col("c.exec_id").alias("exec_id"), late.alias("expired"))


def winning_claim(comments: DataFrame) -> DataFrame:
    """issue, exec_id: of several claims the one with the lowest id wins."""
    return comments.where("kind = 'claim'").groupBy("issue").agg(F.min_by("exec_id", "id").alias("exec_id"))
