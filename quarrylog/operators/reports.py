"""Rankings, texts and metrics around analyses: cooldown, profiles, alert texts, price joins, histograms of durations, sample metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due(lines: DataFrame, tasks: DataFrame, as_of, minutes: int = 30, kind: str = "scheduled") -> DataFrame:
    """Lines without a task of that kind in the last minutes."""
    recent = tasks.where((F.col("task_type") == kind) & (F.col("created_at") > F.lit(as_of) - F.make_dt_interval(mins=F.lit(minutes))))
    return lines.join(recent.select("line_id").distinct(), "line_id", "left_anti")


def top_per(rows: DataFrame, most: int, keys: list[str], *order: Column) -> DataFrame:
    """The first most rows of each key in an order that must be total, with their place. Spark drops rows beyond it before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def known_issues(issues: DataFrame, most: int = 8, *keys: str) -> DataFrame:
    """A line's best known issues: by quality, then hits, then how lately they were seen, nulls last."""
    return top_per(issues, most, list(keys), F.desc_nulls_last("quality"), F.desc_nulls_last("hits"), F.desc_nulls_last("last_seen"), F.asc("id"))


def best_rules(rules: DataFrame, most: int = 10, least: float = 0.6, *keys: str) -> DataFrame:
    return top_per(rules.where(F.col("confidence") >= least), most, list(keys), F.desc("verified"), F.desc("hits"), F.desc("confidence"), F.asc("id"))


def profile_text(issues: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """A line's history and rules as text: one numbered line for each, best first. Both are bounded by their top counts."""
    lines = lambda df, c: df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda s: F.concat(s["place"].cast("string"), F.lit(". "), s[c])), "\n").alias("t"))
    both = lines(issues, "content").withColumnRenamed("t", "history").join(lines(rules, "rule").withColumnRenamed("t", "rules"), key, "full_outer")
    return both.select(key, F.concat_ws("\n\n", F.concat(F.lit("Known issues:\n"), F.col("history")), F.concat(F.lit("Rules:\n"), F.col("rules"))).alias("profile"))


def alert_text(severity: Column, line: Column, content: Column, seen: Column, regressed: Column) -> Column:
    """The heading says whether an issue came back, is new, or how often it was seen."""
    label = F.when(regressed, "regression").when(seen <= 1, "first seen").otherwise(F.concat(F.lit("known, "), seen.cast("string"), F.lit(" times")))
    return F.concat(F.lit("## ["), F.upper(severity), F.lit("] "), line, F.lit(" ("), label, F.lit(")\n"), F.substring(content, 1, 500))


def section(title: str, rows: DataFrame, keys: list[str], text: Column, order: str, most: int = 20) -> DataFrame:
    """Rows of a key as a titled list of at most so many lines, in order."""
    own = rows.select(*keys, F.struct(F.col(order), text.alias("t")).alias("s"))
    top = own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("s"))).where(F.col("place") <= most)
    return top.groupBy(*keys).agg(F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(F.lit("- "), s["t"])), "\n")).alias("section"))


def priced(usage: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """usage (model, tokens, ...) with its cost by the model's price for 1000 tokens, or a default one. The price list is a parameter-sized table."""
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost", F.round(F.col("tokens") / 1000 * F.coalesce("price", F.lit(default)), 6)).drop("price")


def duration_histogram(rows: DataFrame, c: str, bounds: tuple[int, ...], *keys: str) -> DataFrame:
    """How many values are at most each bound, cumulatively, with count and sum, in one pass."""
    upto = [F.count_if(F.col(c) <= b).alias(f"le_{b}") for b in bounds]
    return rows.groupBy(*keys).agg(*upto, F.count("*").alias("count"), F.sum(c).alias("sum"))


def stage_durations(metrics: DataFrame) -> DataFrame:
    """metrics (task_id, stage_metrics as JSON) -> task_id, total_ms, errors: durations summed, errors split at semicolons."""
    rows = F.from_json("stage_metrics", "array<struct<stage string, duration_ms long, status string, error string>>")
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r["duration_ms"], F.lit(0)))
    errors = F.flatten(F.transform(F.filter(rows, lambda r: F.coalesce(r["error"], F.lit("")) != ""), lambda r: F.transform(F.split(r["error"], ";"), lambda x: F.trim(x))))
    return metrics.select("task_id", F.coalesce(total, F.lit(0)).alias("total_ms"), F.coalesce(errors, F.array().cast("array<string>")).alias("errors"))


def sample_metrics(sample: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct groups, time span in seconds and severities of a sample."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return sample.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"), F.floor((F.max(at) - F.min(at)) / 1_000_000).alias("span_seconds"), F.countDistinct("severity").alias("severities"))


def failover(answers: DataFrame, preferred: Column | None = None) -> DataFrame:
    """answers (task_id, provider_id, priority, ok, answer) of all providers that were asked -> task_id, provider_id, answer, tried: the first that gave one, the preferred provider before all, then by
    priority; null where all failed. tried counts those before it, too."""
    order = F.struct(F.when(F.lit(False) if preferred is None else F.coalesce(preferred, F.lit(False)), 0).otherwise(1).alias("a"), (-F.col("priority")).alias("p"), F.col("provider_id").alias("i"))
    rows = answers.select("task_id", "provider_id", "answer", "ok", order.alias("order"))
    taken = rows.groupBy("task_id").agg(F.min(F.when(F.col("ok"), F.struct("order", "provider_id", "answer"))).alias("first"), F.array_sort(F.collect_list("order")).alias("orders"))
    tried = F.when(F.col("first").isNull(), F.size("orders")).otherwise(F.size(F.filter("orders", lambda o: o <= F.col("first.order"))))
    return taken.select("task_id", "first.provider_id", "first.answer", tried.alias("tried"))
