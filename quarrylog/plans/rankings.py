"""Queries for rankings and metrics: cooldown, known issues, prices, histograms, stage durations, sample metrics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrylog.operators import reports as R
from quarrylog.operators import sampling, tools
from quarrylog.plans.registry import CALLS, LINES, LOGS, TASKS, query
from quarrylog.sources import tables as T


@query("due_lines", f"with {TASKS}, {LINES}, m as (select max(created_at) as t from tasks) select line_id, name from lines where line_id not in (select line_id from tasks, m where task_type = 'scheduled' and created_at > t - interval 4320 minutes)")
def due_lines(spark, sf_dir):
    tasks = T.tasks(spark, sf_dir)
    return R.due(T.lines(spark, sf_dir).select("line_id", "name"), tasks, tasks.agg(F.max("created_at")).first()[0], 4320)


ISSUES = "issues as (select doc_id as id, source as line, case when doc_id % 3 > 0 then doc_id % 3 end as quality, n_chars % 50 as hits, doc_id % 100 as last_seen from documents)"


def issues(spark, sf_dir):
    key = F.col("doc_id")
    return T.table(spark, sf_dir, "documents").select(key.alias("id"), F.col("source").alias("line"), F.when(key % 3 > 0, key % 3).alias("quality"), (F.col("n_chars") % 50).alias("hits"), (key % 100).alias("last_seen"))


@query("profile_top8", f"with {ISSUES} select line, id, place from (select *, row_number() over (partition by line order by quality desc nulls last, hits desc nulls last, last_seen desc nulls last, id)::int as place from issues) where place <= 8")
def profile_top8(spark, sf_dir):
    return R.known_issues(issues(spark, sf_dir), 8, "line").select("line", "id", "place")


@query("known_issue_page", f"with {ISSUES} select id, line, hits from issues order by hits desc, id limit 20 offset 20")
def known_issue_page(spark, sf_dir):
    return T.page(issues(spark, sf_dir).select("id", "line", "hits"), 2, 20, F.desc("hits"), "id")


@query("alert_texts", f"with {ISSUES} select id, '## [ERROR] ' || line || ' (' || case when id % 7 = 0 then 'regression' when hits <= 1 then 'first seen' else 'known, ' || hits || ' times' end || ')' || chr(10) || 'issue ' || id as text from issues where line is not null")
def alert_texts(spark, sf_dir):
    rows = issues(spark, sf_dir).where("line is not null")
    return rows.select("id", R.alert_text(F.lit("error"), F.col("line"), F.concat(F.lit("issue "), F.col("id")), F.col("hits"), F.col("id") % 7 == 0).alias("text"))


@query("cost_by_model", f"with {TASKS}, p as (select unnest(['manual', 'scheduled']) as model, unnest([0.01, 0.02]) as price) select task_id, task_type as model, round(tokens / 1000::double * coalesce(price, 0.005)::double, 6) as cost from tasks left join p on task_type = model")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("manual", 0.01), ("scheduled", 0.02)], "model string, price double")
    return R.priced(T.tasks(spark, sf_dir).select("task_id", F.col("task_type").alias("model"), "tokens"), prices, 0.005).select("task_id", "model", "cost")


@query("duration_histogram", f"with {CALLS} select tool, count(*) filter (duration_ms <= 500) as le_500, count(*) filter (duration_ms <= 1000) as le_1000, count(*) filter (duration_ms <= 5000) as le_5000, count(*) as count, sum(duration_ms)::bigint as sum from calls group by 1")
def duration_histogram(spark, sf_dir):
    return R.duration_histogram(T.tool_calls(spark, sf_dir), "duration_ms", (500, 1000, 5000), "tool")


@query("stage_durations", "select o_orderkey as task_id, (o_orderkey % 100 + o_custkey % 50)::bigint as total_ms, case when o_orderkey % 9 = 0 then 'a,b' else '' end as errors from orders")
def stage_durations(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    stage = lambda name, ms, error: F.struct(F.lit(name).alias("stage"), ms.alias("duration_ms"), F.lit("ok").alias("status"), error.alias("error"))
    rows = F.to_json(F.array(stage("fetch", F.col("o_orderkey") % 100, F.when(F.col("o_orderkey") % 9 == 0, "a; b")), stage("parse", F.col("o_custkey") % 50, F.lit(None).cast("string"))))
    return R.stage_durations(o.select(F.col("o_orderkey").alias("task_id"), rows.alias("stage_metrics"))).withColumn("errors", F.array_join("errors", ","))


@query("severity_metrics", f'with {LOGS} select service, count(*) as "rows", count(distinct user_id) as groups, floor(extract(epoch from max(ts) - min(ts)))::bigint as span_seconds, count(distinct level) as severities from logs group by 1')
def severity_metrics(spark, sf_dir):
    return R.sample_metrics(T.logs(spark, sf_dir).select("service", "ts", F.col("user_id").alias("group"), F.col("level").alias("severity")), "service")


@query("adaptive_budgets", f"with {LOGS}, g as (select service, count(*) as n, count(distinct user_id) as groups from logs group by 1), r as (select *, case when service = 0 then 0.5::double else groups / (service * 40)::double end as r from g) select service, case when n <= 150 then n else least(greatest(floor(150::double * case when r > 0.5 then least(1.5, 1 + r - 0.5) when r < 0.1 then greatest(0.6, 0.6 + 4 * r) else 1.0 end), 20), 300)::bigint end as budget from r")
def adaptive_budgets(spark, sf_dir):
    by = T.logs(spark, sf_dir).groupBy("service").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("groups"))
    return by.select("service", sampling.adaptive_budget(F.col("n"), F.col("groups"), F.col("service") * 40).cast("long").alias("budget"))


@query(
    "tool_patterns",
    f"with {LOGS} select regexp_extract(message, '([\\w.]+(?:Exception|Error|Throwable|Fault))', 1) as value, count(*) as n from logs where level = 'ERROR' group by 1 order by n desc, value limit 50",
)
def tool_patterns(spark, sf_dir):
    return tools.count_error_patterns(T.logs(spark, sf_dir), "pattern")


@query("tool_context", f"with {LOGS} select log_id, level from logs where ts between timestamp '2024-01-10 11:00:00' and timestamp '2024-01-10 13:00:00' and level in ('WARNING', 'ERROR') order by ts, log_id limit 50")
def tool_context(spark, sf_dir):
    return tools.log_context(T.logs(spark, sf_dir), datetime.datetime(2024, 1, 10, 12), 60).select("log_id", "level")


@query(
    "tool_baseline",
    """with e as (select ts from events where event_type = 'error'), d as (select k, (select count(*) from e where ts between timestamp '2024-01-20 08:00:00' - k * interval 1 day and timestamp '2024-01-20 12:00:00' - k * interval 1 day) as c from range(0, 8) r(k)),
    b as (select coalesce(round_even(avg(c) filter (c > 0 and k > 0), 0), 0)::bigint as baseline, count(*) filter (c > 0 and k > 0) as days, sum(c) filter (k = 0)::bigint as current from d) select current, baseline, days, round(current / greatest(baseline, 1)::double, 4) as ratio from b""",
)
def tool_baseline(spark, sf_dir):
    return tools.compare_with_baseline(T.logs(spark, sf_dir), datetime.datetime(2024, 1, 20, 8), datetime.datetime(2024, 1, 20, 12))


@query("tool_services", f"with {LOGS} select service::varchar as value, count(*) as n from logs where level = 'ERROR' and service <> 3 and ts between timestamp '2024-01-05' and timestamp '2024-01-20' group by 1 order by n desc, value limit 5")
def tool_services(spark, sf_dir):
    return tools.other_services(T.logs(spark, sf_dir), 3, datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20))
