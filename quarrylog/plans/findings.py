"""Queries about findings and known issues: write-back, origin of logs, regressions, related lines, rules, states, seen fingerprints."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.operators import dedup as U
from quarrylog.operators import priority as P
from quarrylog.operators import reports as R
from quarrylog.operators import tools
from quarrylog.plans.registry import RESULTS, TASKS, query
from quarrylog.sources import tables as T

NOW = datetime.datetime(2024, 2, 1)


@query(
    "issue_write_back",
    "select doc_id as task_id, source as line, substr(text, 1, 3000) as content, 'open' as status, 1::bigint as hits, timestamp '2024-02-01' as created_at, timestamp '2024-02-01' as first_seen, timestamp '2024-02-01' as last_seen, timestamp '2024-02-08' as expire_at, null::timestamp as resolved_at, null::varchar as quality from documents",
)
def issue_write_back(spark, sf_dir):
    return U.write_back(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("line"), F.col("text").alias("content")), NOW)


@query(
    "log_metadata",
    "select event_id as log_id, case when event_id % 11 = 0 then '' else 'site' || (user_id % 5) end as domain, '' as pod_name, case when event_id % 11 = 0 then '' else event_type end as branch, '' as filetype, '1.' || (user_id % 7) as image_version, case when event_id % 13 = 0 then '' else 'h' || (event_id % 13) end as host_name from events",
)
def log_metadata(spark, sf_dir):
    """Origins from a JSON document of each event; in some of them an object is a plain string, or missing."""
    e, key, user = T.table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    gy = F.when(key % 11 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('{"domain": "site'), user % 5, F.lit('", "branch": "'), F.col("event_type"), F.lit('"}')))
    host = F.when(key % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(', "host": {"name": "h'), key % 13, F.lit('"}')))
    source = F.concat(F.lit('{"gy": '), gy, F.lit(', "image": {"version": "1.'), user % 7, F.lit('"}'), host, F.lit("}"))
    return e.select(key.alias("log_id"), X.metadata(source).alias("m")).select("log_id", "m.*")


@query(
    "regression_override",
    f"""with {TASKS}, s as (select task_id, log_count % 100 as score, task_id % 9 = 0 as back from tasks), p as (select *, case when score >= 70 then 'P0' when score >= 40 then 'P1' else 'P2' end as own from s)
    select task_id, score, case when back then 'P0' else own end as priority, back or own <> 'P2' as notify, back as wake, case when back then '🔄 [回归] 已修复的问题再次出现 — 自动升级为 P0 (原始评分: ' || score || ')' else 'by score' end as reason from p""",
)
def regression_override(spark, sf_dir):
    tasks = T.tasks(spark, sf_dir).select("task_id", (F.col("log_count") % 100).alias("score")).withColumn("priority", P.priority(F.col("score")))
    act = P.action(F.col("priority"), F.lit(False), F.lit("p0_only"), F.lit(False))
    decided = tasks.withColumn("a", act).select("task_id", "score", "priority", "a.notify", "a.wake", F.lit("by score").alias("reason"))
    return P.override_regressions(decided, F.col("task_id") % 9 == 0)


@query(
    "task_confidence",
    f"with {TASKS}, {RESULTS}, r as (select task_id, max(case when result_id % 3 = 0 then null when severity = 'critical' then 0.95::double when severity = 'warning' then 0.8::double else 0.6::double end) as top, count(*) as n from results group by 1) select task_id, case when n is null then 0.6::double else coalesce(top, 0.7::double) end as confidence from tasks left join r using (task_id)",
)
def task_confidence(spark, sf_dir):
    """A third of the findings has a severity without a confidence of its own; a task without findings counts as info."""
    severity = F.when(F.col("result_id") % 3 == 0, "error").otherwise(F.col("severity"))
    top = P.top_confidence(T.results(spark, sf_dir).select("task_id", severity.alias("severity")), "task_id")
    return T.tasks(spark, sf_dir).select("task_id").join(top, "task_id", "left").na.fill(0.6, ["confidence"])


EDGES = "e as (select distinct c_nationkey as line, s_nationkey as up from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey and l_linenumber = 1 and l_quantity >= 45)"


@query(
    "related_lines",
    f"""with {EDGES}, a as (select line, up as related, 0 as k from e union all select up, line, 1 from e), r as (select *, row_number() over (partition by line order by k, related) as place from a)
    select r.line::bigint as line_id, place::int as place, related::bigint as related, case when e.up is null then 'downstream' else 'upstream' end as direction from r left join e on e.line = r.line and e.up = r.related where place <= 6""",
)
def related_lines(spark, sf_dir):
    """A line is a nation; above it are those whose suppliers serve its customers in large first items, below it those it serves."""
    t = lambda name: T.table(spark, sf_dir, name)
    items = t("lineitem").where("l_linenumber = 1 and l_quantity >= 45").select("l_orderkey", "l_suppkey")
    sold = items.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").cast("long").alias("line"), F.col("s_nationkey").cast("long").alias("up")).distinct()
    ends = edges.select(F.col("line").alias("line_id"), F.col("up").alias("above"), F.lit(None).cast("long").alias("below")).union(edges.select("up", F.lit(None).cast("long"), "line"))
    own = ends.groupBy("line_id").agg(F.array_sort(F.collect_list("above")).alias("above"), F.array_sort(F.collect_list("below")).alias("below"))
    listed = own.select("line_id", F.posexplode(tools.related(F.col("above"), F.col("below"))).alias("place", "r"))
    return listed.select("line_id", (F.col("place") + 1).alias("place"), F.col("r.service").alias("related"), F.col("r.direction").alias("direction"))


RULES = """seen as (select l_orderkey % 20 as line_id, 'part ' || (l_partkey % 50) || ' fails' as rule, l_discount * 10 as confidence, l_shipdate as ts from lineitem where l_partkey % 50 > 0),
 rules as (select md5(line_id || ':' || rule) as id, line_id, rule, max(confidence) as confidence, count(*) as hits, max(ts) as last_seen from seen where length(rule) >= 10 group by 1, 2, 3)"""


def rules(spark, sf_dir):
    """The rules of even orders are the old table, those of the others are merged into it."""
    i = T.table(spark, sf_dir, "lineitem").where("l_partkey % 50 > 0")
    rule = F.concat(F.lit("part "), F.col("l_partkey") % 50, F.lit(" fails"))
    seen = i.select("l_orderkey", (F.col("l_orderkey") % 20).alias("line_id"), rule.alias("rule"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_shipdate").alias("ts"))
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema}
    empty = spark.createDataFrame([], f"id string, line_id {kinds['line_id']}, rule string, confidence {kinds['confidence']}, hits long, last_seen {kinds['ts']}")
    return U.upsert_rules(U.upsert_rules(empty, seen.where("l_orderkey % 2 = 0")), seen.where("l_orderkey % 2 = 1"))


@query("rules_upsert", f"with {RULES} select * from rules")
def rules_upsert(spark, sf_dir):
    return rules(spark, sf_dir)


@query("rules_top10", f"with {RULES} select id, line_id, place from (select *, row_number() over (partition by line_id order by hits % 2 = 1 desc, hits desc, confidence desc, id)::int as place from rules where confidence >= 0.6) where place <= 10")
def rules_top10(spark, sf_dir):
    return R.best_rules(rules(spark, sf_dir).withColumn("verified", F.col("hits") % 2 == 1), 10, 0.6, "line_id").select("id", "line_id", "place")


@query(
    "issue_status",
    """with u as (select doc_id as id, case when max(toxic) = 1 then 'ignored' when max(quality) = 1 then 'verified' else 'resolved' end as t from labels group by 1)
    select doc_id as id, case when t in ('ignored', 'resolved') then t else 'open' end as status, case when t = 'ignored' then 'poor' end as quality, case when t = 'resolved' then timestamp '2024-02-01' end as resolved_at, case when t = 'verified' then timestamp '2025-01-31' else timestamp '2024-02-08' end as expire_at from documents left join u on doc_id = id""",
)
def issue_status(spark, sf_dir):
    issues = U.write_back(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("content")), NOW)
    marks = T.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("good"))
    to = F.when(F.col("toxic") == 1, "ignored").when(F.col("good") == 1, "verified").otherwise("resolved")
    updates = marks.select("id", to.alias("to"), F.lit(NOW).cast("timestamp_ntz").alias("at"))
    return U.set_status(issues, updates).select("id", "status", "quality", "resolved_at", "expire_at")


@query("fingerprints_kept", "select event_type || (user_id % 50) as fingerprint, max(case when event_id % 2 = 1 then timestamp '2024-02-01 06:00:00' else ts + interval 10 days end) as expire_at from events where event_id % 2 = 1 or ts + interval 10 days > timestamp '2024-02-01' group by 1")
def fingerprints_kept(spark, sf_dir):
    """Even events were seen at their time for ten days; the others are seen now, for six hours."""
    e = T.table(spark, sf_dir, "events").select("event_id", "ts", F.concat("event_type", F.col("user_id") % 50).alias("fingerprint"))
    seen = e.where("event_id % 2 = 0").select("fingerprint", (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(10))).alias("expire_at"))
    return U.remember(seen, e.where("event_id % 2 = 1"), NOW, 6 * 3600)


@query(
    "alert_states",
    f"with {TASKS} select task_id as alert_id, case when task_id % 3 = 1 then 'acknowledged' when task_id % 3 = 2 then 'resolved' else 'fired' end as status, case when task_id % 3 > 0 then timestamp '2024-02-01' end as acked_at, case when task_id % 3 = 2 then timestamp '2024-02-01' end as resolved_at from tasks",
)
def alert_states(spark, sf_dir):
    none = F.lit(None).cast("timestamp_ntz")
    key = T.tasks(spark, sf_dir).select(F.col("task_id").alias("alert_id"))
    alerts = key.select("alert_id", F.lit("fired").alias("status"), none.alias("acked_at"), none.alias("resolved_at"))
    to = F.when(F.col("alert_id") % 3 == 1, "acknowledged").otherwise("resolved")
    return P.acknowledge(alerts, key.where("alert_id % 3 > 0").select("alert_id", to.alias("to"), F.lit(NOW).cast("timestamp_ntz").alias("at")))
