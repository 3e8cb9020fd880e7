"""Priority of findings and what to do about them, learning from acknowledgements, alert states and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V


def score(severity: Column, confidence: Column, current: Column, baseline: Column, weight: Column, core: Column, log_count: Column, stacks: Column, types: Column, history: Column) -> Column:
    """0 to 100: severity, frequency against the baseline, the line's weight and core path, confidence, bonus, history."""
    base = X.lookup(severity, {"critical": 30.0, "error": 25.0, "warning": 15.0, "info": 5.0}, 5.0)
    frequency = F.least(5.0 * current / F.greatest(baseline, F.lit(1)), F.lit(25.0))
    clamp = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    line = 2.5 * clamp(weight, 1, 10) + F.when(core, 10.0).otherwise(0.0)
    bonus = F.when(stacks & severity.isin("critical", "error"), 3.0).otherwise(0.0) + F.when(types >= 3, 5.0).otherwise(0.0) + F.when(log_count >= 500, 3.0).when(log_count >= 100, 1.0).otherwise(0.0)
    return clamp(base + frequency + line + 10.0 * F.least(confidence, F.lit(1.0)) + bonus + clamp(history, -15.0, 10.0), 0.0, 100.0)


def priority(score_: Column) -> Column:
    return F.when(score_ >= 70, "P0").when(score_ >= 40, "P1").otherwise("P2")


def is_night(ts: Column, hours: str = "22:00-08:00", offset_hours: int = 8) -> Column:
    """Whether a UTC time lies in the night of a place so many hours east; the end is exclusive, midnight may lie between."""
    start, end = (int(h) * 60 + int(m) for h, m in (x.split(":") for x in hours.split("-")))
    local = ts + F.make_dt_interval(hours=F.lit(offset_hours))
    minute = F.hour(local) * 60 + F.minute(local)
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def action(level: Column, night: Column, policy: Column, suppressed: Column) -> Column:
    """struct(notify, wake, delay): P0 at once, at night by policy; P1 by day, at night only with always; P2 never; suppressed never."""
    p0, p1 = level == "P0", level == "P1"
    loud = policy.isin("always", "p0_only")
    notify = ~suppressed & ((p0 & (~night | (policy != "silent"))) | (p1 & (~night | (policy == "always"))))
    wake = ~suppressed & p0 & night & loud
    delay = ~suppressed & night & ((p0 & (policy == "silent")) | (p1 & (policy != "always")))
    return F.struct(notify.alias("notify"), wake.alias("wake"), delay.alias("delay"))


def override_regressions(decisions: DataFrame, regressed: Column) -> DataFrame:
    """decisions (score, priority, notify, wake, reason, ...): issues that came back after they were resolved are P0, told at once and at night."""
    back = F.coalesce(regressed, F.lit(False))
    changed = {"priority": F.lit("P0"), "notify": F.lit(True), "wake": F.lit(True), "reason": F.format_string(V.REGRESSION_REASON, F.col("score").cast("string"))}
    return decisions.withColumns({name: F.when(back, c).otherwise(F.col(name)) for name, c in changed.items()})


def top_confidence(results: DataFrame, *keys: str) -> DataFrame:
    """Of the most severe finding of each key; 0.7 where no severity is known. A null severity counts as info."""
    known = X.lookup(F.coalesce("severity", F.lit("info")), V.SEVERITY_CONFIDENCE)
    return results.groupBy(*keys).agg(F.coalesce(F.max(known), F.lit(0.7)).alias("confidence"))


def adjustment(alerts: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """From alerts (keys, status) and results (keys, feedback): 15 * (share acknowledged - 0.5) of 3 or more, 5 * mean feedback of 2 or more, within -15 and 10."""
    acked = alerts.groupBy(*keys).agg(F.count("*").alias("alerts"), F.count_if(F.col("status").isin("acknowledged", "resolved")).alias("acked"))
    rated = results.where("feedback is not null").groupBy(*keys).agg(F.count("*").alias("rated"), F.sum("feedback").alias("sum"))
    both = acked.join(rated, list(keys), "full_outer").na.fill(0)
    raw = F.when(F.col("alerts") >= 3, (F.col("acked") / F.col("alerts") - 0.5) * 15).otherwise(0.0) + F.when(F.col("rated") >= 2, F.col("sum") / F.col("rated") * 5).otherwise(0.0)
    return both.select(*keys, F.round(F.least(F.greatest(raw, F.lit(-15.0)), F.lit(10.0)), 4).alias("adjustment"))


def fatigued(alerts: DataFrame, since, least: int = 5, *keys: str) -> DataFrame:
    """Keys with so many alerts since then that nobody acknowledged."""
    return alerts.where((F.col("status") == "fired") & (F.col("fired_at") >= F.lit(since))).groupBy(*keys).agg(F.count("*").alias("unacked")).where(F.col("unacked") >= least)


def task_inputs(results: DataFrame) -> DataFrame:
    """Per task: the highest severity, the largest confidence (0.5 at least) and the number of distinct findings."""
    rank = X.lookup(F.col("severity"), {"info": 0, "warning": 1, "error": 2, "critical": 3}, 0)
    return results.groupBy("task_id").agg(F.max(F.struct(rank.alias("r"), "severity"))["severity"].alias("severity"), F.greatest(F.max("confidence"), F.lit(0.5)).alias("confidence"), F.greatest(F.countDistinct(F.substring("content", 1, 80)), F.lit(1)).alias("types"))


def alertable(results: DataFrame) -> DataFrame:
    """Findings worth an alert; a task without any gives its first result."""
    worthy = F.col("severity").isin("critical", "warning", "error") & (F.col("confidence") >= 0.4)
    some = results.where(worthy)
    rest = results.join(some.select("task_id").distinct(), "task_id", "left_anti").groupBy("task_id").agg(F.min(F.struct("result_id", *[c for c in results.columns if c not in ("task_id", "result_id")])).alias("r"))
    return some.unionByName(rest.select("task_id", "r.*"))


def acknowledge(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """alerts (alert_id, status, acked_at, resolved_at) with updates (alert_id, to, at); resolving acknowledges too."""
    out = alerts.join(updates, "alert_id", "left")
    to = F.col("to")
    cols = {"status": F.coalesce(to, F.col("status")), "acked_at": F.when(to.isin("acknowledged", "resolved"), F.coalesce("acked_at", "at")).otherwise(F.col("acked_at")), "resolved_at": F.when(to == "resolved", F.col("at")).otherwise(F.col("resolved_at"))}
    return out.withColumns(cols).drop("to", "at")


def token_cost(tokens: Column, price_per_thousand: Column) -> Column:
    return tokens / 1000 * price_per_thousand


RESULT = "array<struct<result_type string, severity string, content string, confidence_score double, error_signals array<string>, experience_rule string, source_log_refs array<string>>>"


def parse_results(answer: Column) -> Column:
    """A model's answer as an array of results: code fences go, one object is a list of one; what doesn't parse is null."""
    body = F.trim(F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    listed = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    rows = F.from_json(listed, RESULT)
    cut = lambda r: F.struct(
        F.coalesce(r["result_type"], F.lit("anomaly")).alias("result_type"), F.coalesce(r["severity"], F.lit("info")).alias("severity"), F.coalesce(r["content"], F.lit("")).alias("content"), F.coalesce(r["confidence_score"], F.lit(0.5)).alias("confidence"),
        F.array_distinct(F.filter(F.coalesce(r["error_signals"], F.array().cast("array<string>")), lambda s: F.char_length(s).between(3, 60))).alias("signals"),
        F.when(F.char_length(r["experience_rule"]).between(10, 200), r["experience_rule"]).alias("rule"), F.transform(F.slice(F.coalesce(r["source_log_refs"], F.array().cast("array<string>")), 1, 20), lambda s: F.substring(s, 1, 200)).alias("refs"),
    )
    return F.transform(rows, cut)


