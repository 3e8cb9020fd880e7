"""Roll-ups of analysis history: overview, trends, health, cost, savings, feedback, tools, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import values as V


def when_count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def skip_kinds() -> dict[str, Column]:
    """How a completed task without tokens was skipped; what neither filter names is a semantic hit, a null message included."""
    idle = (F.col("status") == "completed") & (F.col("tokens") == 0)
    said = F.coalesce("error_message", F.lit(""))
    quality, seen = said.contains(V.QUALITY_SKIP), said.contains(V.FINGERPRINT_SKIP)
    return {"quality_filtered": idle & quality, "fingerprint_skipped": idle & seen, "semantic_dedup": idle & ~quality & ~seen}


def measures() -> list[Column]:
    return [F.count("*").alias("total"), when_count(F.col("status") == "completed").alias("completed"), when_count(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("log_count"), F.lit(0)).alias("logs")]


def overview(tasks: DataFrame, *keys) -> DataFrame:
    return tasks.groupBy(*keys).agg(*measures()) if keys else tasks.agg(*measures())


def time_rollup(tasks: DataFrame, since, unit: str, days: int) -> DataFrame:
    """The five measures by day or hour; hours become days beyond a week."""
    unit = "day" if unit == "hour" and days > 7 else unit
    return overview(tasks.where(F.col("created_at") >= F.lit(since)), F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket"))


def severity_counts(results: DataFrame, tasks: DataFrame, *keys: str) -> DataFrame:
    joined = results.join(tasks.select("task_id", *[k for k in keys if k != "severity"]), "task_id")
    return joined.groupBy(*keys).agg(F.count("*").alias("n"))


def business_health(tasks: DataFrame, results: DataFrame, lines: DataFrame) -> DataFrame:
    """Per line: measures, critical and warning results, and 100 less 15 for each critical, 5 for each warning, 20 times the failed share, within 0 and 100.

    Results are counted per task before the join with tasks, and per line after it; lines without tasks have zeros.
    """
    marks = results.where(F.col("severity").isin("critical", "warning")).groupBy("task_id").agg(when_count(F.col("severity") == "critical").alias("critical"), when_count(F.col("severity") == "warning").alias("warning"))
    by = tasks.join(marks, "task_id", "left").groupBy("line_id").agg(*measures(), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"), F.coalesce(F.sum("warning"), F.lit(0)).alias("warning"))
    out = lines.join(by, "line_id", "left").na.fill(0, ["total", "completed", "failed", "tokens", "logs", "critical", "warning"])
    raw = 100 - 15 * F.col("critical") - 5 * F.col("warning") - 20 * F.col("failed") / F.greatest("total", F.lit(1))
    return out.select("line_id", "name", "total", "completed", "failed", "critical", "warning", F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1).alias("health"))


def cost(tasks: DataFrame) -> DataFrame:
    """Tokens, tasks that used some, tasks that were skipped and how; what they would have used on the whole average."""
    sums = tasks.agg(F.count("*").alias("total_tasks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), when_count(F.col("tokens") > 0).alias("ai_tasks"), *[when_count(c).alias(k) for k, c in skip_kinds().items()])
    sums = sums.withColumn("avg_tokens", F.floor(F.col("total_tokens") / F.greatest("ai_tasks", F.lit(1))))
    sums = sums.withColumn("saved", (F.col("quality_filtered") + F.col("fingerprint_skipped") + F.col("semantic_dedup")) * F.col("avg_tokens"))
    return sums.withColumn("savings_pct", F.round(F.col("saved") * 100 / F.greatest(F.col("total_tokens") + F.col("saved"), F.lit(1)), 1))


def cost_by(tasks: DataFrame, key: str) -> DataFrame:
    return tasks.groupBy(key).agg(F.count("*").alias("tasks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), when_count(F.col("tokens") > 0).alias("ai_tasks"))


def dedup_daily(tasks: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")
    return tasks.groupBy(day).agg(F.count("*").alias("total"), when_count(F.col("tokens") > 0).alias("ai"), *[when_count(c).alias(k) for k, c in skip_kinds().items()])


def feedback(results: DataFrame, *keys) -> DataFrame:
    """Positive, negative and unrated results and the positive share of the rated, 0 where none is."""
    sums = results.groupBy(*keys).agg(F.count("*").alias("total"), when_count(F.col("feedback") == 1).alias("positive"), when_count(F.col("feedback") == -1).alias("negative"), when_count(F.col("feedback").isNull()).alias("unrated"))
    rated = F.col("positive") + F.col("negative")
    return sums.withColumn("rate", F.when(rated > 0, F.col("positive") / rated).otherwise(0.0))


def mean_minutes(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'completed'").agg(F.count("*").alias("tasks"), F.round(F.avg("minutes"), 4).alias("mean_minutes"))


def processing_minutes(tasks: DataFrame) -> DataFrame:
    """Mean minutes from start to end of completed tasks (status, started_at, completed_at) that have both; rounded to one place, null without any."""
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return tasks.where("status = 'completed' and started_at is not null and completed_at is not null").agg(F.count("*").alias("tasks"), F.round(F.avg(seconds) / 60, 1).alias("mean_minutes"))


def top_patterns(results: DataFrame, most: int = 10) -> DataFrame:
    by = results.groupBy(F.substring("content", 1, 120).alias("pattern")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.max("result_id").alias("latest"))
    return by.orderBy(F.desc("n"), "pattern").limit(most)


def tool_usage(calls: DataFrame) -> DataFrame:
    mean = lambda c: F.floor(F.sum(c) / F.count("*"))
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), when_count(F.col("success")).alias("succeeded"), when_count(~F.col("success")).alias("failed"), mean("duration_ms").alias("avg_ms"), mean("result_length").alias("avg_length"))


def tool_chains(calls: DataFrame, quality: DataFrame, most: int = 10) -> DataFrame:
    """The tools of each task in step order, as a chain; chains by how often they occur, with their mean quality (2 where a task has none) and length."""
    chain = calls.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "tool"))), lambda s: s["tool"]), " → ").alias("chain"), F.count("*").alias("steps"))
    by = chain.join(quality, "task_id", "left").groupBy("chain").agg(F.count("*").alias("tasks"), F.round(F.avg(F.coalesce("quality", F.lit(2))), 4).alias("avg_quality"), F.round(F.avg("steps"), 4).alias("avg_steps"))
    return by.orderBy(F.desc("tasks"), "chain").limit(most)


def chain_quality(results: DataFrame) -> DataFrame:
    mean = F.round(F.avg("confidence"), 6)
    return results.groupBy("task_id").agg(F.when(mean >= 0.8, 3).when(mean >= 0.5, 2).otherwise(1).alias("quality"))


def digest(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Per line: tasks, logs, tokens, critical results and the failed share, lines with most logs first."""
    critical = results.where("severity = 'critical'").groupBy("task_id").agg(F.count("*").alias("critical"))
    by = tasks.join(critical, "task_id", "left").groupBy("line_id").agg(*measures(), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"))
    return by.withColumn("failed_rate", F.round(F.col("failed") / F.col("total"), 4)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("logs"), "line_id")))


def nested(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """Tasks with their tool calls as an array in step order, empty where there are none."""
    own = calls.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("step", "tool", "success"))).alias("calls"))
    return tasks.join(own, "task_id", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<struct<step:bigint,tool:string,success:boolean>>")))


def health(components: DataFrame) -> DataFrame:
    """components (name, status): down if the database or log store is down, degraded if anything isn't ok, else ok."""
    vital = F.max(F.col("name").isin("database", "logs") & (F.col("status") == "down"))
    return components.agg(F.when(vital, "down").when(F.max(F.col("status") != "ok"), "degraded").otherwise("ok").alias("status"))


def tenant_digest(tasks: DataFrame, results: DataFrame, previews: int = 5, preview_chars: int = 150) -> DataFrame:
    """tenant_id, line_id (null: the tenant's row), measures, rates, critical and preview, for tenants with any task.

    Tenants and their lines come from one pass over the tasks by grouping sets. critical counts results that are critical or errors; preview lists the first of them by id and text, cut: each
    task keeps that many for a key before the shuffle, so no list grows with the data.
    """
    sums = tasks.groupingSets([["tenant_id", "line_id"], ["tenant_id"]], "tenant_id", "line_id").agg(*measures(), *[when_count(c).alias(k) for k, c in skip_kinds().items()], F.grouping_id().alias("level"))
    bad = results.where("severity in ('critical', 'error')").join(tasks.select("task_id", "tenant_id", "line_id"), "task_id")
    levels = F.explode(F.array(F.struct(F.col("line_id").alias("own"), F.lit(0).cast("long").alias("level")), F.struct(F.lit(None).cast(tasks.schema["line_id"].dataType).alias("own"), F.lit(1).cast("long").alias("level"))))
    bad = bad.select("tenant_id", "result_id", F.upper("severity").alias("severity"), F.substring(F.coalesce("content", F.lit("")), 1, preview_chars).alias("content"), levels.alias("l")).select("*", "l.own", "l.level").drop("l")
    counts = bad.groupBy("tenant_id", "own", "level").agg(F.count("*").alias("critical"))
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("content"))
    first = F.row_number().over(Window.partitionBy("tenant_id", "own", "level").orderBy("result_id", text))
    shown = bad.withColumn("place", first).where(F.col("place") <= previews).groupBy("tenant_id", "own", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda s: s["t"]), "\n").alias("preview"))
    key = (F.col("s.tenant_id") == F.col("c.tenant_id")) & F.col("s.line_id").eqNullSafe(F.col("c.own")) & (F.col("s.level") == F.col("c.level"))
    both = sums.alias("s").join(counts.join(shown.withColumnRenamed("own", "own2").withColumnsRenamed({"tenant_id": "tenant2", "level": "level2"}), (F.col("tenant_id") == F.col("tenant2")) & F.col("own").eqNullSafe(F.col("own2")) & (F.col("level") == F.col("level2"))).alias("c"), key, "left")
    share = lambda part: F.round(100.0 * F.col(part) / F.col("total"), 1)
    return both.select("s.*", F.coalesce("c.critical", F.lit(0)).alias("critical"), "c.preview").withColumns({"skip_rate": share("quality_filtered"), "success_rate": share("completed"), "tokens_per_task": F.floor(F.col("tokens") / F.greatest("completed", F.lit(1)))}).drop("level")


def period_digest(tasks: DataFrame, results: DataFrame, unit: str = "week") -> DataFrame:
    """Measures, critical results and the share of completed tasks by day, week or month. Results are counted by task before they meet the tasks."""
    critical = results.where("severity = 'critical'").groupBy("task_id").agg(F.count("*").alias("critical"))
    by = tasks.join(critical, "task_id", "left").groupBy(F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias(unit)).agg(*measures(), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"))
    return by.withColumn("success_rate", F.round(100.0 * F.col("completed") / F.col("total"), 1))
