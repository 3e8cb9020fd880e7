"""Queries over analysis history: dashboard roll-ups, cost, feedback, tools, priority, retention."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrylog.operators import dashboard as D
from quarrylog.operators import dedup as U
from quarrylog.operators import priority as P
from quarrylog.plans.registry import CALLS, LINES, MEASURES, RESULTS, SKIPS, TASKS, query
from quarrylog.sources import tables as T

SINCE = datetime.datetime(1997, 1, 1)
SINCE_SQL = "timestamp '1997-01-01 00:00:00'"


@query("overview", f"with {TASKS} select {MEASURES} from tasks")
def overview(spark, sf_dir):
    return D.overview(T.tasks(spark, sf_dir))


@query("severity_distribution", f"with {TASKS}, {RESULTS} select severity, count(*) as n from results join tasks using (task_id) group by 1")
def severity_distribution(spark, sf_dir):
    return D.severity_counts(T.results(spark, sf_dir), T.tasks(spark, sf_dir), "severity")


@query("severity_by_line", f"with {TASKS}, {RESULTS} select line_id, severity, count(*) as n from results join tasks using (task_id) group by 1, 2")
def severity_by_line(spark, sf_dir):
    return D.severity_counts(T.results(spark, sf_dir), T.tasks(spark, sf_dir), "line_id", "severity")


@query("trends_day", f"with {TASKS} select date_trunc('day', created_at)::timestamp as bucket, {MEASURES} from tasks where created_at >= {SINCE_SQL} group by 1")
def trends_day(spark, sf_dir):
    return D.time_rollup(T.tasks(spark, sf_dir), SINCE, "hour", 30)


@query("trends_hour", f"with {TASKS} select date_trunc('hour', created_at)::timestamp as bucket, {MEASURES} from tasks where created_at >= {SINCE_SQL} group by 1")
def trends_hour(spark, sf_dir):
    return D.time_rollup(T.tasks(spark, sf_dir), SINCE, "hour", 7)


@query(
    "business_health",
    f"""with {TASKS}, {RESULTS}, {LINES}, m as (select task_id, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning from results group by 1),
    b as (select line_id, {MEASURES}, coalesce(sum(critical), 0)::bigint as critical, coalesce(sum(warning), 0)::bigint as warning from tasks left join m using (task_id) group by 1)
    select line_id, name, coalesce(total, 0) as total, coalesce(completed, 0) as completed, coalesce(failed, 0) as failed, coalesce(critical, 0) as critical, coalesce(warning, 0) as warning,
    round_even(least(greatest(100 - 15 * coalesce(critical, 0) - 5 * coalesce(warning, 0) - 20.0::double * coalesce(failed, 0) / greatest(coalesce(total, 0), 1), 0.0), 100.0), 1) as health from lines left join b using (line_id)""",
)
def business_health(spark, sf_dir):
    return D.business_health(T.tasks(spark, sf_dir), T.results(spark, sf_dir), T.lines(spark, sf_dir))


@query(
    "cost_savings",
    f"with {TASKS}, a as (select count(*) as total_tasks, coalesce(sum(tokens), 0)::bigint as total_tokens, count(*) filter (tokens > 0) as ai_tasks, {SKIPS} from tasks), b as (select *, total_tokens // greatest(ai_tasks, 1) as avg_tokens from a), c as (select *, (quality_filtered + fingerprint_skipped + semantic_dedup) * avg_tokens as saved from b) select *, round(saved * 100 / greatest(total_tokens + saved, 1), 1) as savings_pct from c",
)
def cost_savings(spark, sf_dir):
    return D.cost(T.tasks(spark, sf_dir))


@query("cost_by_line", f"with {TASKS} select line_id, count(*) as tasks, coalesce(sum(tokens), 0)::bigint as tokens, count(*) filter (tokens > 0) as ai_tasks from tasks group by 1")
def cost_by_line(spark, sf_dir):
    return D.cost_by(T.tasks(spark, sf_dir), "line_id")


@query("cost_by_type", f"with {TASKS} select task_type, count(*) as tasks, coalesce(sum(tokens), 0)::bigint as tokens, count(*) filter (tokens > 0) as ai_tasks from tasks group by 1")
def cost_by_type(spark, sf_dir):
    return D.cost_by(T.tasks(spark, sf_dir), "task_type")


@query("dedup_daily", f"with {TASKS} select date_trunc('day', created_at)::timestamp as day, count(*) as total, count(*) filter (tokens > 0) as ai, {SKIPS} from tasks group by 1")
def dedup_daily(spark, sf_dir):
    return D.dedup_daily(T.tasks(spark, sf_dir))


RATES = "count(*) as total, count(*) filter (feedback = 1) as positive, count(*) filter (feedback = -1) as negative, count(*) filter (feedback is null) as unrated"


@query("feedback_stats", f"with {RESULTS}, a as (select severity, {RATES} from results group by 1) select *, case when positive + negative > 0 then positive::double / (positive + negative) else 0.0 end as rate from a")
def feedback_stats(spark, sf_dir):
    return D.feedback(T.results(spark, sf_dir), "severity")


@query("accuracy_daily", f"with {TASKS}, {RESULTS}, a as (select date_trunc('day', created_at)::timestamp as day, {RATES} from results join tasks using (task_id) group by 1) select *, case when positive + negative > 0 then positive::double / (positive + negative) else 0.0 end as rate from a")
def accuracy_daily(spark, sf_dir):
    joined = T.results(spark, sf_dir).join(T.tasks(spark, sf_dir).select("task_id", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")), "task_id")
    return D.feedback(joined, "day")


@query("document_feedback", "with a as (select source, case when toxic = 1 then -1 when quality = 1 then 1 end as feedback from documents left join labels using (doc_id)), b as (select source, count(*) as total, count(*) filter (feedback = 1) as positive, count(*) filter (feedback = -1) as negative, count(*) filter (feedback is null) as unrated from a group by 1) select *, case when positive + negative > 0 then positive::double / (positive + negative) else 0.0 end as rate from b")
def document_feedback(spark, sf_dir):
    docs, labels = (T.table(spark, sf_dir, t) for t in ("documents", "labels"))
    rated = docs.select("doc_id", "source").join(labels, "doc_id", "left").withColumn("feedback", F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1))
    return D.feedback(rated, "source")


@query("mean_processing", f"with {TASKS} select count(*) as tasks, round(avg(minutes), 4) as mean_minutes from tasks where status = 'completed'")
def mean_processing(spark, sf_dir):
    return D.mean_minutes(T.tasks(spark, sf_dir))


@query("top_patterns", f"with {RESULTS} select substr(content, 1, 120) as pattern, count(*) as n, round(avg(confidence), 4) as avg_confidence, max(result_id) as latest from results group by 1 order by n desc, pattern limit 10")
def top_patterns(spark, sf_dir):
    return D.top_patterns(T.results(spark, sf_dir))


@query("tool_usage", f"with {CALLS} select tool, count(*) as calls, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, (sum(duration_ms) // count(*))::bigint as avg_ms, (sum(result_length) // count(*))::bigint as avg_length from calls group by 1")
def tool_usage(spark, sf_dir):
    return D.tool_usage(T.tool_calls(spark, sf_dir))


@query(
    "tool_chains",
    f"with {CALLS}, {RESULTS}, q as (select task_id, case when round(avg(confidence), 6) >= 0.8 then 3 when round(avg(confidence), 6) >= 0.5 then 2 else 1 end as quality from results group by 1), c as (select task_id, string_agg(tool, ' → ' order by step) as chain, count(*) as steps from calls group by 1) select chain, count(*) as tasks, round(avg(coalesce(quality, 2)), 4) as avg_quality, round(avg(steps), 4) as avg_steps from c left join q using (task_id) group by 1 order by tasks desc, chain limit 10",
)
def tool_chains(spark, sf_dir):
    return D.tool_chains(T.tool_calls(spark, sf_dir), D.chain_quality(T.results(spark, sf_dir)))


@query(
    "digest_by_line",
    f"with {TASKS}, {RESULTS}, k as (select task_id, count(*) as critical from results where severity = 'critical' group by 1), b as (select line_id, {MEASURES}, coalesce(sum(critical), 0)::bigint as critical from tasks left join k using (task_id) group by 1) select *, round(failed::double / total, 4) as failed_rate, row_number() over (order by logs desc, line_id)::int as place from b",
)
def digest_by_line(spark, sf_dir):
    return D.digest(T.tasks(spark, sf_dir), T.results(spark, sf_dir))


@query("recent_tasks", f"with {TASKS} select task_id, line_id, status, created_at from tasks order by created_at desc, task_id desc limit 10 offset 10")
def recent_tasks(spark, sf_dir):
    return T.page(T.tasks(spark, sf_dir).select("task_id", "line_id", "status", "created_at"), 2, 10, F.desc("created_at"), F.desc("task_id"))


@query("retention_keep", f"with {TASKS}, {RESULTS} select task_id, count(*) as results from results where task_id in (select task_id from tasks where created_at >= {SINCE_SQL}) group by 1")
def retention_keep(spark, sf_dir):
    _, kept = U.retain(T.tasks(spark, sf_dir), T.results(spark, sf_dir), "task_id", SINCE)
    return kept.groupBy("task_id").agg(F.count("*").alias("results"))


INPUTS = "i as (select task_id, max_by(severity, case severity when 'critical' then 3 when 'warning' then 1 else 0 end) as severity, greatest(max(confidence), 0.5) as confidence, greatest(count(distinct substr(content, 1, 80)), 1) as types from results group by 1)"


@query(
    "priority_scores",
    f"""with {TASKS}, {RESULTS}, {LINES}, {INPUTS}, s as (select t.task_id, least(greatest(case severity when 'critical' then 30.0 when 'error' then 25.0 when 'warning' then 15.0 else 5.0 end + least(5.0 * log_count / greatest(500, 1), 25.0) + 2.5 * least(greatest(weight, 1), 10) + case when core then 10.0 else 0.0 end + 10.0 * least(confidence, 1.0)
    + case when types >= 3 and severity in ('critical', 'error') then 3.0 else 0.0 end + case when types >= 3 then 5.0 else 0.0 end + case when log_count >= 500 then 3.0 when log_count >= 100 then 1.0 else 0.0 end, 0.0), 100.0)::double as s
    from tasks t join i using (task_id) join lines using (line_id)) select task_id, round(s, 4) as score, case when round(s, 4) >= 70 then 'P0' when round(s, 4) >= 40 then 'P1' else 'P2' end as priority from s""",
)
def priority_scores(spark, sf_dir):
    rows = T.tasks(spark, sf_dir).join(P.task_inputs(T.results(spark, sf_dir)), "task_id").join(F.broadcast(T.lines(spark, sf_dir)), "line_id")
    score = P.score(F.col("severity"), F.col("confidence"), F.col("log_count"), F.lit(500), F.col("weight"), F.col("core"), F.col("log_count"), F.col("types") >= 3, F.col("types"), F.lit(0.0))
    return rows.select("task_id", F.round(score, 4).alias("score")).withColumn("priority", P.priority(F.col("score")))


@query(
    "night_actions",
    """with t as (select event_id, ['P0', 'P1', 'P2'][(event_id % 3 + 1)::int] as p, ['always', 'p0_only', 'silent'][(event_id % 4 % 3 + 1)::int] as policy, event_id % 11 = 0 as quiet, extract(hour from ts + interval 8 hours) as h from events),
    n as (select *, h >= 22 or h < 8 as night from t)
    select p as priority, policy, night, count(*) as n, count(*) filter (not quiet and ((p = 'P0' and (not night or policy <> 'silent')) or (p = 'P1' and (not night or policy = 'always')))) as notified,
    count(*) filter (not quiet and p = 'P0' and night and policy in ('always', 'p0_only')) as woken, count(*) filter (not quiet and night and ((p = 'P0' and policy = 'silent') or (p = 'P1' and policy <> 'always'))) as delayed from n group by 1, 2, 3""",
)
def night_actions(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    rows = e.select(pick(("P0", "P1", "P2"), F.col("event_id") % 3).alias("priority"), pick(("always", "p0_only", "silent"), F.col("event_id") % 4 % 3).alias("policy"), P.is_night(F.col("ts")).alias("night"), (F.col("event_id") % 11 == 0).alias("quiet"))
    rows = rows.withColumn("a", P.action(F.col("priority"), F.col("night"), F.col("policy"), F.col("quiet")))
    return rows.groupBy("priority", "policy", "night").agg(F.count("*").alias("n"), F.count_if("a.notify").alias("notified"), F.count_if("a.wake").alias("woken"), F.count_if("a.delay").alias("delayed"))


@query(
    "priority_adjustment",
    f"""with {TASKS}, {RESULTS}, a as (select line_id, count(*) as alerts, count(*) filter (status <> 'failed') as acked from tasks group by 1), f as (select line_id, count(*) as rated, sum(feedback) as s from results join tasks using (task_id) where feedback is not null group by 1)
    select line_id, round(least(greatest(case when alerts >= 3 then (acked::double / alerts - 0.5) * 15 else 0.0 end + case when rated >= 2 then s::double / rated * 5 else 0.0 end, -15.0), 10.0), 4) as adjustment from a full join f using (line_id)""",
)
def priority_adjustment(spark, sf_dir):
    tasks = T.tasks(spark, sf_dir)
    alerts = tasks.select("line_id", F.when(F.col("status") == "failed", "fired").otherwise("acknowledged").alias("status"))
    return P.adjustment(alerts, T.results(spark, sf_dir).join(tasks.select("task_id", "line_id"), "task_id"), "line_id")


@query("fatigue", f"with {TASKS} select line_id, count(*) as unacked from tasks where status = 'failed' and created_at >= {SINCE_SQL} group by 1 having count(*) >= 5")
def fatigue(spark, sf_dir):
    alerts = T.tasks(spark, sf_dir).select("line_id", F.when(F.col("status") == "failed", "fired").otherwise("acknowledged").alias("status"), F.col("created_at").alias("fired_at"))
    return P.fatigued(alerts, SINCE, 5, "line_id")


@query("alertable", f"with {RESULTS}, s as (select * from results where severity in ('critical', 'warning', 'error') and confidence >= 0.4) select result_id, task_id, severity from s union all select result_id, task_id, severity from (select *, row_number() over (partition by task_id order by result_id, severity) as i from results where task_id not in (select task_id from s)) where i = 1")
def alertable(spark, sf_dir):
    return P.alertable(T.results(spark, sf_dir)).select("result_id", "task_id", "severity")


@query("task_tree", f"with {TASKS}, {CALLS}, c as (select task_id, count(*) as n, string_agg(tool, ',' order by step) as tools from calls group by 1) select task_id, coalesce(n, 0)::int as n_calls, coalesce(tools, '') as tools from tasks left join c using (task_id)")
def task_tree(spark, sf_dir):
    tree = D.nested(T.tasks(spark, sf_dir), T.tool_calls(spark, sf_dir))
    return tree.select("task_id", F.size("calls").alias("n_calls"), F.array_join(F.transform("calls", lambda c: c["tool"]), ",").alias("tools"))


LAST = "x as (select * from (select *, row_number() over (partition by side, signature order by seq desc, severity desc, confidence desc) as i from (select result_id % 2 as side, result_id as seq, severity, confidence, content || '/' || (task_id % 400) as signature from results)) where i = 1)"


@query(
    "compare_changes",
    f"""with {RESULTS}, {LAST}, r as (select *, case severity when 'critical' then 3 when 'warning' then 1 else 0 end as k from x), j as (select coalesce(a.signature, b.signature) as signature, a.severity as before, b.severity as after, a.k as ak, b.k as bk, round(b.confidence - a.confidence, 9) as d from (select * from r where side = 0) a full join (select * from r where side = 1) b using (signature))
    select signature, case when before is null then 'new' when after is null then 'resolved' when bk > ak then 'worsened' when bk < ak then 'improved' when d > 0.15 then 'worsened' when d < -0.15 then 'improved' else 'unchanged' end as change, before, after from j""",
)
def compare_changes(spark, sf_dir):
    rows = T.results(spark, sf_dir).select(F.concat("content", F.lit("/"), F.col("task_id") % 400).alias("signature"), "severity", "confidence", F.col("result_id").alias("seq"))
    return U.compare(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))
