"""Queues, evidence gates, approvals and append-only version tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.plans.scratch import Scratch


def review_queue(candidates: DataFrame, budget: int, anomaly_slots: int, anomaly_threshold: float, audit_slots: int, seed: str) -> DataFrame:
    """Random audit of the whole eligible set, then priority, anomaly reserve and fill; at most ``budget`` rows, ranked.

    Each route is an ordered limit, which Spark takes as a top-k of each partition, and is written once (at most ``budget`` rows);
    the next one leaves out the ids of those before by an anti-join. An audit row has the probability with which the draw takes
    any eligible candidate, whatever the other routes do after it; the others are chosen, not drawn, and have none.
    """
    scratch, eligible = Scratch(candidates.sparkSession, "queue"), candidates.where("eligible")
    order_id = [F.lower("candidate_id"), F.col("candidate_id")]
    by_priority = [F.col("priority").desc(), F.col("anomaly").desc(), *order_id]
    by_anomaly = [F.col("anomaly").desc(), F.col("priority").desc(), *order_id]
    chosen: list[DataFrame] = []

    def take(route: str, order: list, slots: int, where: str = "true") -> int:
        """Write the route's rows; returns how many they are."""
        rest = eligible.where(where)
        if chosen:
            rest = rest.join(reduce(DataFrame.unionByName, (c.select("candidate_id") for c in chosen)), "candidate_id", "left_anti")
        place = F.row_number().over(Window.orderBy(*order))  # over the route's rows, at most the budget
        chosen.append(scratch.table(rest.orderBy(*order).limit(max(0, slots)).withColumn("place", place).withColumn("route", F.lit(route)), route))
        return chosen[-1].count()

    audited = take("random_audit", [F.sha2(F.concat(F.lit(f"{seed}\0"), "candidate_id"), 256), *order_id], min(audit_slots, budget))
    reserve = min(anomaly_slots, budget - audited)
    first = take("priority", by_priority, budget - audited - reserve)
    reserved = take("anomaly_reserve", by_anomaly, reserve, f"anomaly >= {anomaly_threshold}")
    take("priority_fill", by_priority, budget - audited - first - reserved)
    turn = F.when(F.col("route") == "priority", 0).when(F.col("route") == "anomaly_reserve", 1).when(F.col("route") == "priority_fill", 2).otherwise(3)
    queue = reduce(DataFrame.unionByName, chosen).withColumn("rank", F.row_number().over(Window.orderBy(turn, "place")))
    population = eligible.agg(F.count("*").alias("population"))  # one row
    propensity = F.when(F.col("route") == "random_audit", F.lit(float(audited)) / F.col("population"))
    return queue.crossJoin(F.broadcast(population)).select("rank", "candidate_id", "priority", "anomaly", "route", propensity.alias("propensity"))


def routed_queue(candidates: DataFrame, routes: list[tuple]) -> DataFrame:
    """Rows of each route (name, condition, order, slots) in turn, without those that an earlier one took; ties by id."""
    chosen: list[DataFrame] = []
    for name, condition, order, slots in routes:
        rest = candidates.where(condition)
        if chosen:
            rest = rest.join(reduce(DataFrame.unionByName, (c.select("candidate_id") for c in chosen)), "candidate_id", "left_anti")
        chosen.append(rest.orderBy(*order, "candidate_id").limit(slots).select("candidate_id", F.lit(name).alias("route")))
    return reduce(DataFrame.unionByName, chosen)


def latest_checks(checks: DataFrame) -> DataFrame:
    """Per source and service: the newest check, and whether several different ones are equally new."""
    newest = F.max("checked_hour").over(Window.partitionBy("source_id", "service"))
    now = checks.withColumn("newest", newest).where("checked_hour = newest")
    return now.groupBy("source_id", "service").agg(F.min("newest").alias("checked_hour"), F.min_by("status", "attempt").alias("status"), F.min_by("expires_hour", "attempt").alias("expires_hour"), (F.countDistinct("status") > 1).alias("conflicting"))


def evidence_gate(sources: DataFrame, checks: DataFrame, required: list[str], now_hour: int) -> DataFrame:
    """Fail-closed decision: match, then incomplete, then quality, then manual, then reportable, with the reasons of that step.

    ``sources`` has quality_passed and manual_required. A match counts whenever it was found; a clear counts if it is the
    newest check of its service, fresh and not contradicted. A source without a verdict on its quality hasn't passed.
    """
    need = sources.select("source_id", F.explode(F.array(*(F.lit(s) for s in required))).alias("service"))
    matched = checks.groupBy("source_id", "service").agg(F.bool_or(F.col("status") == "match").alias("matched"))
    j = need.join(latest_checks(checks), ["source_id", "service"], "left").join(matched, ["source_id", "service"], "left")
    reason = F.when(F.col("status").isNull(), "missing").when(F.col("conflicting"), "conflicting").when(F.col("status") != "clear", F.col("status")).when(F.col("expires_hour") <= now_hour, "expired")
    named = lambda when, word: F.array_join(F.sort_array(F.collect_list(F.when(when, F.concat_ws(":", "service", word)))), ",")
    g = j.withColumn("reason", reason).groupBy("source_id").agg(
        F.bool_or(F.coalesce("matched", F.lit(False))).alias("any_match"), F.count("reason").alias("n_open"), named(F.col("matched"), F.lit("match")).alias("matches"), named(F.col("reason").isNotNull(), F.col("reason")).alias("open")
    )
    g = g.join(sources.select("source_id", F.coalesce("quality_passed", F.lit(False)).alias("passed"), F.coalesce("manual_required", F.lit(True)).alias("manual")), "source_id")
    decision = F.when(F.col("any_match"), "match").when(F.col("n_open") > 0, "incomplete").when(~F.col("passed"), "quality").when(F.col("manual"), "manual").otherwise("reportable")
    return g.select("source_id", decision.alias("decision"), F.when(F.col("any_match"), F.col("matches")).otherwise(F.col("open")).alias("reasons"))


def current_versions(reviews: DataFrame) -> DataFrame:
    """Per candidate: the version of its newest row."""
    return reviews.groupBy("candidate").agg(F.max_by("version", F.struct("day", "review_id")).alias("version"))


def active_decisions(reviews: DataFrame) -> DataFrame:
    """Latest decision of every reviewer in each role on a candidate version."""
    keys = ["candidate", "version", "reviewer", "role"]
    return reviews.groupBy(*keys).agg(F.max_by("verdict", "review_id").alias("verdict"))


def approvals(reviews: DataFrame) -> DataFrame:
    """Per candidate at its current version: approved by a screener and a different reviewer, and not rejected."""
    act = active_decisions(reviews).join(current_versions(reviews), ["candidate", "version"])
    yes = lambda role: F.collect_set(F.when((F.col("role") == role) & (F.col("verdict") == "approve"), F.col("reviewer")))
    g = act.groupBy("candidate", "version").agg(yes("screener").alias("s"), yes("reviewer").alias("r"), F.bool_or(F.col("verdict") == "reject").alias("rejected"), F.count("*").alias("n_active"))
    pair = (F.size("s") > 0) & (F.size("r") > 0) & (F.size(F.array_union("s", "r")) > 1)
    return g.select("candidate", "version", "n_active", "rejected", (pair & ~F.col("rejected")).alias("approved"))


def outcome_report(candidates: DataFrame, reviews: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per campaign: reviews, outcomes, labels, yield among the reviewed, disagreement and hours to the first review.

    ``candidates`` has candidate, version (the current one), campaign and recorded_hour; only ``reviews`` (hour, reviewer, role,
    verdict) of that version count. ``outcomes`` has candidate and label (1, 0, or null: observed without a binary label). A
    first review before its record, or one without a time, is an invalid latency.
    """
    own = reviews.join(candidates.select("candidate", "version"), ["candidate", "version"])
    per = own.groupBy("candidate").agg(F.count("*").alias("events"), F.min("hour").alias("first_hour"), (F.count_distinct("verdict") > 1).alias("disagreed"))
    seen = outcomes.groupBy("candidate").agg(F.max("label").alias("label")).withColumn("observed", F.lit(True))
    j = candidates.join(per, "candidate", "left").join(seen, "candidate", "left")
    reviewed, labelled, observed = F.col("events").isNotNull(), F.col("label").isin(0, 1), F.coalesce("observed", F.lit(False))
    hours = F.col("first_hour") - F.col("recorded_hour")
    g = j.groupBy("campaign").agg(
        F.count("*").alias("candidates"), F.coalesce(F.sum("events"), F.lit(0)).alias("review_events"), F.count_if(reviewed).alias("reviewed"), F.count_if(observed).alias("observed"), F.count_if(~observed).alias("missing"),
        F.count_if(labelled).alias("labelled"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(reviewed & labelled).alias("reviewed_labelled"), F.count_if(reviewed & (F.col("label") == 1)).alias("reviewed_positive"),
        F.count_if(F.coalesce("disagreed", F.lit(False))).alias("disagreements"), F.count_if(reviewed & ~F.coalesce(hours >= 0, F.lit(False))).alias("invalid_latency"), F.median(F.when(hours >= 0, hours)).alias("median_hours"),
    )
    return g.withColumn("review_yield", F.col("reviewed_positive") / F.nullif("reviewed_labelled", F.lit(0)))


def nightly_quota(rows: DataFrame, quota: int) -> DataFrame:
    """First ``quota`` rows of each day, by id; the rest are marked over quota."""
    n = F.row_number().over(Window.partitionBy("day").orderBy("review_id"))
    return rows.select("review_id", "day", (n <= quota).alias("accepted"))


def transitions(states: DataFrame, allowed: DataFrame) -> DataFrame:
    """Successive states of a candidate that the relation does not allow."""
    w = Window.partitionBy("candidate").orderBy("day", "review_id")
    pairs = states.withColumn("before", F.lag("state").over(w)).where("before is not null and before <> state")
    bad = pairs.join(F.broadcast(allowed), (pairs.before == allowed.from_state) & (pairs.state == allowed.to_state), "left_anti")
    return bad.groupBy("before", "state").agg(F.count("*").alias("n"))


def append_outcomes(new: DataFrame, current: DataFrame) -> DataFrame:
    """``new`` rows with an outcome: only rows against the exact current version of a known candidate are accepted."""
    known = current.select(F.col("candidate").alias("_candidate"), F.col("version").alias("_version"))
    outcome = F.when(F.col("_version").isNull(), "unknown_candidate").when(F.col("_version") != F.col("version"), "stale_version").otherwise("accepted")
    return new.join(known, new.candidate == known._candidate, "left").withColumn("outcome", outcome).drop("_candidate", "_version")
