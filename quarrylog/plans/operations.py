"""Queries of the operating side: known issues by vector, webhooks, digests, catalogs, snapshots, stages, agent tools."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.operators import agent_sql, alerts, dashboard, dedup, priority, pruned, reports, search, stages, timeseries, tools
from quarrylog.plans.findings import EDGES, related_lines
from quarrylog.plans.registry import CALLS, LOGS, MEASURES, RESULTS, SKIPS, TASKS, query
from quarrylog.sources import scratch, snapshots, vectors
from quarrylog.sources import tables as T
from quarrylog.streaming import webhooks

NOW = datetime.datetime(2024, 1, 15)


@query(
    "analysis_history_hit",
    """with q as (select vec_id as query_id, label as ql, list_transform(embedding::double[], lambda x, i: x * (1 + (i - 1) % 3 * 0.2)) as q from embeddings where vec_id % 20 = 0),
    l as (select vec_id, label, embedding::double[] as v from embeddings where timestamp '2024-01-10' + to_days((vec_id % 14)::int) >= timestamp '2024-01-15' and vec_id % 5 <> 3),
    s as (select query_id, vec_id, list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v)) as c from q join l on label = ql),
    r as (select *, row_number() over (partition by query_id order by c desc, vec_id)::int as place from s where (1 + c) / 2 >= 0.92)
    select query_id, vec_id, round(c, 6) as score, place from r where place = 1""",
)
def analysis_history_hit(spark, sf_dir):
    """The nearest issue of the same line that has not expired and isn't marked poor, if its score, half of one and the cosine, is 0.92 or more. New errors are known vectors, distorted."""
    e = T.table(spark, sf_dir, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (1 + i % 3 * 0.2))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), scaled.alias("q"), "label")
    expires = F.expr("timestamp_ntz '2024-01-10' + make_dt_interval(cast(vec_id % 14 as int))")
    issues = e.select("vec_id", F.col("embedding").alias("v"), "label", expires.alias("expire_at"), F.when(F.col("vec_id") % 5 == 3, "poor").alias("quality"))
    return known_issue_hits(asked, issues, NOW)


def known_issue_hits(asked, issues, now, k: int = 1, least_score: float = 0.92):
    """asked (query_id, q, label), issues (vec_id, v, label, expire_at, quality) -> the k nearest of the line's live issues that are near enough."""
    live = (F.col("expire_at") >= F.lit(now).cast("timestamp_ntz")) & ~F.col("quality").eqNullSafe(F.lit("poor"))
    return pruned.nearest(asked, issues, k, 2 * least_score - 1, "label", where=live)[0]


URLS = ("https://qyapi.weixin.qq.com/send?key=", "https://wecom.example/hook/", "https://oapi.dingtalk.com/robot/", "https://open.feishu.cn/hook/", "https://lark.example/", "https://example.org/hook/")


@query(
    "webhook_payloads",
    f"""with u as (select c_custkey as alert_id, case when c_custkey % 7 = 6 then '' else {list(URLS)}[c_custkey % 7 + 1] || c_custkey end as url, 'Alert for ' || c_name || ' in ' || c_nationkey as t from customer)
    select alert_id, case when url like '%qyapi.weixin%' or url like '%wecom%' then 'wechat' when url like '%dingtalk%' then 'dingtalk' when url like '%feishu%' or url like '%lark%' then 'feishu' else 'generic' end as kind,
    case when url like '%dingtalk%' then to_json({{'msgtype': 'markdown', 'markdown': {{'title': '告警通知', 'text': t}}}})::varchar when url like '%feishu%' or url like '%lark%' then to_json({{'msg_type': 'text', 'content': {{'text': t}}}})::varchar
    else to_json({{'msgtype': 'markdown', 'markdown': {{'content': t}}}})::varchar end as body from u where url <> ''""",
)
def webhook_payloads(spark, sf_dir):
    """Alerts to customers by the service at their address."""
    c = T.table(spark, sf_dir, "customer")
    url = F.when(F.col("c_custkey") % 7 == 6, "").otherwise(F.concat(F.get(F.array(*map(F.lit, URLS)), (F.col("c_custkey") % 7).cast("int")), F.col("c_custkey").cast("string")))
    rows = c.select(F.col("c_custkey").alias("alert_id"), url.alias("url"), F.concat(F.lit("Alert for "), "c_name", F.lit(" in "), F.col("c_nationkey").cast("string")).alias("t"))
    return rows.select("alert_id", webhooks.kind_of(F.col("url")).alias("kind"), webhooks.payload(F.col("url"), F.col("t")).alias("body")).where("body is not null")


@query(
    "tenant_digest",
    f"""with {TASKS}, {RESULTS}, t as (select *, line_id % 3 as tenant_id from tasks where line_id <> 7),
    s as (select tenant_id, line_id, grouping_id(tenant_id, line_id) as level, {MEASURES}, {SKIPS} from t group by grouping sets ((tenant_id, line_id), (tenant_id))),
    b as (select t.tenant_id, t.line_id, r.result_id, '[' || upper(r.severity) || '] ' || substr(r.content, 1, 150) as c from results r join t using (task_id) where r.severity in ('critical', 'error')),
    a as (select tenant_id, line_id as own, 0 as level, result_id, c from b union all select tenant_id, null, 1, result_id, c from b),
    k as (select tenant_id, own, level, count(*) as critical, array_to_string((list(c order by result_id, c))[1:5], chr(10)) as preview from a group by 1, 2, 3)
    select s.tenant_id, s.line_id, total, completed, failed, tokens, logs, quality_filtered, fingerprint_skipped, semantic_dedup, coalesce(critical, 0) as critical, preview, round(100.0 * quality_filtered / total, 1)::double as skip_rate, round(100.0 * completed / total, 1)::double as success_rate,
    tokens // greatest(completed, 1) as tokens_per_task from s left join k on k.tenant_id = s.tenant_id and k.own is not distinct from s.line_id and k.level = s.level""",
)
def tenant_digest(spark, sf_dir):
    """Tenants own lines by turns of three; line 7 belongs to none."""
    tasks = T.tasks(spark, sf_dir).where("line_id <> 7").withColumn("tenant_id", F.col("line_id") % 3)
    return dashboard.tenant_digest(tasks, T.results(spark, sf_dir))


@query(
    "other_indices",
    f"""with {LOGS}, n as (select distinct case when service = 5 then '.sys-' else 'app-' end || service || '-' || strftime(ts, '%Y.%m.%d') as name from logs)
    select name from n where not starts_with(name, '.') and contains(lower(name), '2024.01') and not starts_with(name, 'app-0-') and not starts_with(name, 'app-1-2024.01.0') and not starts_with(name, 'app-2') order by name limit 50""",
)
def other_indices(spark, sf_dir):
    """The first indices that don't belong to a line with three patterns; one for each service and day."""
    rows = T.logs(spark, sf_dir)
    name = F.concat(F.when(F.col("service") == 5, ".sys-").otherwise("app-"), F.col("service").cast("string"), F.lit("-"), F.date_format("ts", "yyyy.MM.dd"))
    own = spark.createDataFrame([("app-0-*, app-1-2024.01.0*",), ("app-2*",), ("*",)], "pattern string")
    return tools.other_indices(rows.select(name.alias("name")), own, "2024.01", 50)


@query(
    "tenant_snapshot",
    f"""with {TASKS}, t as (select task_id as id, line_id % 3 as tenant_id, case when line_id % 3 = 1 and minutes = 2 then 'failed' else status end as status, case when line_id % 3 = 1 and minutes = 2 then null else tokens end as tokens, minutes from tasks)
    select id, tenant_id::varchar as tenant_id, status, tokens from t where not (tenant_id = 1 and minutes = 3) union all select task_id + 1000000000, '2', 'pending', tokens from tasks where line_id % 3 = 0 and minutes = 1""",
)
def tenant_snapshot(spark, sf_dir):
    """A tenant's tasks are corrected and removed, another's added; of updates for rows of other tenants nothing is left."""
    tasks = T.tasks(spark, sf_dir)
    folder = scratch.scratch(spark, "tenants")
    rows = tasks.select(F.col("task_id").alias("id"), (F.col("line_id") % 3).alias("tenant_id"), "status", "tokens")
    snapshots.create(rows, folder)
    marked = tasks.select(F.col("task_id").alias("id"), "minutes")
    fixed = marked.where("minutes = 2").select("id", F.lit("failed").alias("status"), F.lit(None).cast("long").alias("tokens"))
    snapshots.change(spark, folder, "1", updates=fixed, deletes=marked.where("minutes = 3"))
    new = tasks.where("line_id % 3 = 0 and minutes = 1").select((F.col("task_id") + 1_000_000_000).alias("id"), F.lit("pending").alias("status"), "tokens")
    snapshots.change(spark, folder, "2", inserts=new)
    return snapshots.read(spark, folder)


def agent(spark, sf_dir):
    """The agent's functions over the given tables: an index for each service, documents' starts as knowledge, vectors as chunks and issues."""
    rows = T.logs(spark, sf_dir).withColumn("index_name", F.concat(F.when(F.col("service") == 5, ".sys-").otherwise("app-"), F.col("service").cast("string")))
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("content"), F.col("embedding").alias("v"))
    agent_sql.register(spark, rows, rows.groupBy(F.col("index_name").alias("name")).agg(F.count("*").alias("docs")), e, e.select(F.col("chunk_id").alias("issue_id"), F.lit("warning").alias("severity"), "content", "v"))
    return spark


INDEXED = f"{LOGS}, ix as (select *, case when service = 5 then '.sys-' else 'app-' end || service as index_name from logs)"
SHOWN = "log_id, level, service::varchar as service, message[1:500] as message"


@query("tool_search_logs", f"with {LOGS} select {SHOWN} from logs where level = 'ERROR' and contains(lower(message), 'request 1') and ts >= timestamp '2024-01-03' order by ts desc, log_id desc limit 30")
def tool_search_logs(spark, sf_dir):
    return agent(spark, sf_dir).sql("SELECT log_id, level, service, message FROM search_logs('REQUEST 1', timestamp'2024-01-03', NULL, 'error', 30)")


@query("tool_log_context", f"with {LOGS} select {SHOWN} from logs where level in ('WARNING', 'ERROR') and ts between timestamp '2024-01-15 06:00:00' and timestamp '2024-01-15 10:00:00' order by ts, log_id limit 50")
def tool_log_context(spark, sf_dir):
    return agent(spark, sf_dir).sql("SELECT log_id, level, service, message FROM get_log_context(timestamp'2024-01-15 08:00:00', 120)")


@query("tool_error_patterns", f"with {LOGS} select 'service' as by, service::varchar as key, count(*) as n from logs where level = 'ERROR' group by 1, 2 union all select * from (select 'pattern', regexp_extract(message, '([\\w.]+(?:Exception|Error|Throwable|Fault))', 1), count(*) from logs where level = 'ERROR' and ts >= timestamp '2024-01-10' group by 1, 2)")
def tool_error_patterns(spark, sf_dir):
    """Two calls in one statement."""
    return agent(spark, sf_dir).sql("SELECT 'service' AS by, * FROM count_error_patterns(NULL, NULL, 'service') UNION ALL SELECT 'pattern', * FROM count_error_patterns(timestamp'2024-01-10', NULL)")


@query("tool_indices", f"with {INDEXED} select index_name as name, count(*) as docs from ix where not starts_with(index_name, '.') group by 1")
def tool_indices(spark, sf_dir):
    return agent(spark, sf_dir).sql("SELECT * FROM list_available_indices('app-*')")


NEAR = "with q as (select list_transform(embedding::double[], lambda x, i: x * (1 + (i - 1) % 3 * 0.2)) as q from embeddings where vec_id = 7), s as (select vec_id, list_dot_product(q, embedding::double[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) as score from q, embeddings)"


def asked_vector(spark, sf_dir) -> str:
    """One vector, distorted, as a literal."""
    v = T.table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (1 + i % 3 * 0.2)).alias("v")).first()["v"]
    return "array(" + ", ".join(f"{x!r}D" for x in v) + ")"


@query("tool_knowledge", NEAR + " select vec_id as chunk_id, 'chunk ' || vec_id as content, round(score, 6) as score from s where score >= 0.2 order by score desc, vec_id limit 3")
def tool_knowledge(spark, sf_dir):
    return agent(spark, sf_dir).sql(f"SELECT * FROM search_knowledge_base({asked_vector(spark, sf_dir)}, 0.2D)")


@query("tool_similar_incidents", NEAR + " select vec_id as issue_id, 'warning' as severity, 'chunk ' || vec_id as content, round(score, 6) as score from s order by score desc, vec_id limit 5")
def tool_similar_incidents(spark, sf_dir):
    return agent(spark, sf_dir).sql(f"SELECT * FROM search_similar_incidents({asked_vector(spark, sf_dir)}, 9)")


@query("tool_cross_service", f"with {INDEXED}, o as (select distinct index_name from ix where not starts_with(index_name, '.') and not starts_with(index_name, 'app-0') and not starts_with(index_name, 'app-1') order by 1 limit 5) select log_id, service::varchar as service, message[1:200] as message from ix where level = 'ERROR' and contains(lower(message), 'sqlexception') and index_name in (select index_name from o) order by ts desc, log_id desc limit 10")
def tool_cross_service(spark, sf_dir):
    return agent(spark, sf_dir).sql("SELECT log_id, service, message FROM search_cross_service_logs('SQLException', 'app-0*, app-1', NULL, NULL)")


@query(
    "analysis_stages",
    f"""with {LOGS}, e as (select * from logs where level = 'ERROR'), x as (select distinct service, split_part(message, ':', 1) as kind from e)
    select 'errors' as stage, 'ok' as status, (select count(*) from e)::bigint as rows union all select 'patterns', 'ok', (select count(*) from x) union all select 'enrich', 'error', null union all select 'known', 'ok', (select count(*) from x where kind like '%SQL%') union all select 'inference', 'skipped', null""",
)
def analysis_stages(spark, sf_dir):
    """Metrics of five stages: two critical ones in one plan, an optional one that fails, another that works, and one that is skipped for what was found."""
    own = [
        stages.Stage("errors", lambda d: d.where("level = 'ERROR'")),
        stages.Stage("patterns", lambda d: d.select("service", F.substring_index("message", ":", 1).alias("kind")).distinct()),
        stages.Stage("enrich", lambda d: d.withColumn("x", F.raise_error(F.lit("no service")).cast("int")), critical=False),
        stages.Stage("known", lambda d: d.where("kind like '%SQL%'"), critical=False),
        stages.Stage("inference", lambda d: d, skip=lambda facts: facts["rows_known"] < facts["rows_patterns"]),
    ]
    _, metrics = stages.run(T.logs(spark, sf_dir), own)
    return spark.createDataFrame([(m["stage"], m["status"], m["rows"]) for m in metrics], "stage string, status string, rows long")


FILETYPES = ("app.log.txt", "error.log", "warn.log", "warning.log", "info.log", "debug.log", "other.log", "")


@query("filetype_severity", f"with {LOGS} select log_id from logs where ({list(FILETYPES)})[log_id % 8 + 1] in ('app.log.txt', 'warn.log', 'warning.log') or contains(message, '[WARN]') or lower(level) = 'warning'")
def filetype_severity(spark, sf_dir):
    """Warnings by a level, by a marker in the message, or by the kind of file a log comes from."""
    rows = T.logs(spark, sf_dir)
    filetype = F.get(F.array(*map(F.lit, FILETYPES)), (F.col("log_id") % 8).cast("int"))
    return rows.where(search.severity_filter("warning", [F.lower("level")], F.lit(None).cast("string"), filetype, F.col("message"))).select("log_id")


@query("levels_extracted", f"with {LOGS} select log_id, case log_id % 6 when 0 then lower(level) when 1 then 'critical' when 2 then 'debug' when 3 then 'custom' when 4 then case log_id % 8 when 1 then 'error' when 2 then 'warning' when 3 then 'warning' when 4 then 'info' when 5 then 'debug' else coalesce(case regexp_extract(message, '^\\[(\\w+)\\]', 1) when 'ERROR' then 'error' when 'WARN' then 'warning' when 'INFO' then 'info' end, '') end else coalesce(case regexp_extract(message, '^\\[(\\w+)\\]', 1) when 'ERROR' then 'error' when 'WARN' then 'warning' when 'INFO' then 'info' end, '') end as level from logs")
def levels_extracted(spark, sf_dir):
    """Each sixth of the logs has its level in another field, in the file type, or in the message alone."""
    k, none = F.col("log_id") % 6, F.lit(None).cast("string")
    filetype = F.when(k == 4, F.get(F.array(*map(F.lit, FILETYPES)), (F.col("log_id") % 8).cast("int")))
    level = X.extract_level(F.when(k == 0, F.col("level")), F.when(k == 1, "FATAL"), F.when(k == 2, "Trace"), F.when(k == 3, "Custom"), F.coalesce(filetype, none), F.col("message"))
    return T.logs(spark, sf_dir).select("log_id", level.alias("level"))


@query("messages_found", f"with {LOGS} select log_id, case when log_id % 3 = 0 then message when log_id % 3 = 1 and event_type <> '' then event_type else ('whole ' || message)[1:500] end as message from logs")
def messages_found(spark, sf_dir):
    k = F.col("log_id") % 3
    return T.logs(spark, sf_dir).select("log_id", X.message_of(F.when(k == 0, F.col("message")), F.when(k == 1, F.col("event_type")).otherwise(""), whole=F.concat(F.lit("whole "), "message")).alias("message"))


@query("learned_signals", "with s as (select event_type || (user_id % 40) as signal, max(value) / 100 as confidence, count(*) as hits from events group by 1 union all select 'Caused by:', 1.0, 1000000) select signal, hits from s where confidence >= 0.7 and signal <> 'Caused by:' order by hits desc, signal limit 200")
def learned_signals(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    own = e.groupBy(F.concat("event_type", F.col("user_id") % 40).alias("signal")).agg((F.max("value") / 100).alias("confidence"), F.count("*").alias("hits"))
    fixed = spark.createDataFrame([("Caused by:", 1.0, 1_000_000)], "signal string, confidence double, hits long")
    return search.learned_signals(own.unionByName(fixed)).select("signal", "hits")


@query("dedup_keys", f"with {LOGS} select key, count(*) as n from (select case when contains(message, 'Exception:') then regexp_extract(message, '([\\w.]+Exception)', 1) || ':' || string_split(message, chr(10))[1][1:200] else message[1:200] end as key from logs) group by 1")
def dedup_keys(spark, sf_dir):
    return T.logs(spark, sf_dir).groupBy(X.dedup_key(F.col("message")).alias("key")).agg(F.count("*").alias("n"))


@query("timestamps_parsed", "select event_id, case event_id % 7 when 0 then epoch_us(date_trunc('second', ts)) / 1e6 when 1 then epoch_us(date_trunc('second', ts)) / 1e6 when 2 then epoch_us(date_trunc('millisecond', ts)) / 1e6 when 3 then epoch_us(date_trunc('millisecond', ts)) / 1e6 when 4 then epoch_us(date_trunc('second', ts)) / 1e6 - 7200 when 5 then event_id::double else 0.0 end as seconds from events")
def timestamps_parsed(spark, sf_dir):
    """Times written in several forms, numbers, and texts that are neither."""
    k, ts = F.col("event_id") % 7, F.col("ts").cast("timestamp")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    written = F.coalesce(*[F.when(k == i, F.date_format(ts, f)) for i, f in enumerate(forms)], F.when(k == 5, F.col("event_id").cast("string")), F.lit("yesterday"))
    return T.table(spark, sf_dir, "events").select("event_id", X.parse_timestamp(written).alias("seconds"))


@query(
    "answers_parsed",
    f"""with {RESULTS}, p as (select result_id, severity, content, confidence from results) select result_id, case when result_id % 4 = 3 then null else 'anomaly' end as kind, case when result_id % 4 = 3 then null else severity end as severity, case when result_id % 4 = 3 then null else content end as content,
    case when result_id % 4 = 3 then null when result_id % 4 = 2 then 0.5 else confidence end::double as confidence, case when result_id % 4 = 3 then null else 1 end as signals from p""",
)
def answers_parsed(spark, sf_dir):
    """Answers as one object, as a list in a code fence, without a confidence, and as no JSON at all."""
    r, k = T.results(spark, sf_dir), F.col("result_id") % 4
    body = F.to_json(F.struct("severity", "content", F.when(k != 2, F.col("confidence").cast("double")).alias("confidence_score"), F.array("content", "content", F.lit("x")).alias("error_signals")))
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n["), body, F.lit("]\n```"))).when(k == 2, F.concat(F.lit("  "), body)).otherwise("I cannot say")
    one = F.get(priority.parse_results(answer), F.lit(0))
    return r.select("result_id", one.alias("p")).select("result_id", F.col("p.result_type").alias("kind"), "p.severity", "p.content", F.round("p.confidence", 6).alias("confidence"), F.when(F.col("p").isNotNull(), F.size("p.signals")).alias("signals"))


@query("signals_halved", "with s as (select user_id as id, max(value) / 100 as confidence, max((event_type = 'error')::int) as bad from events group by 1) select id, round(case when bad = 1 then confidence / 2 else confidence end, 6)::double as confidence from s where case when bad = 1 then confidence / 2 else confidence end >= 0.3")
def signals_halved(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    signals = e.groupBy(F.col("user_id").alias("id")).agg((F.max("value") / 100).alias("confidence"))
    return dedup.halve(signals, e.where("event_type = 'error'").select(F.col("user_id").alias("id"))).select("id", F.round("confidence", 6).alias("confidence"))


@query("components_health", "select case when exists (select 1 from supplier where s_nationkey in (0, 1) and s_acctbal < -900) then 'down' when exists (select 1 from supplier where s_acctbal < -900) then 'degraded' else 'ok' end as status")
def components_health(spark, sf_dir):
    """Suppliers as components: those of two nations are vital, and whoever owes much is down."""
    s = T.table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_nationkey") == 0, "database").when(F.col("s_nationkey") == 1, "logs").otherwise(F.col("s_name"))
    return dashboard.health(s.select(name.alias("name"), F.when(F.col("s_acctbal") < -900, "down").otherwise("ok").alias("status")))


@query(
    "alert_labels",
    f"""with {TASKS} select task_id, case task_id % 4 when 0 then '🔴 [P0|' when 1 then '🟡 [P1|' when 2 then '🟢 [P2|' else '🟡 [P1|' end || (task_id % 101) || '分] ' || case when task_id % 5 = 0 then '🔄 [回归] 上次修复于 ' || strftime(created_at, '%Y-%m-%d') || ' | ' when task_id % 5 = 1 then '🆕 [首次发现] ' when task_id % 5 = 3 then '📋 [已知问题|第' || minutes + 1 || '次] ' else '' end as label from tasks""".replace("|| minutes + 1 ||", "|| (minutes + 1) ||"),
)
def alert_labels(spark, sf_dir):
    k = F.col("task_id") % 5
    p = F.when(F.col("task_id") % 4 < 3, F.concat(F.lit("P"), (F.col("task_id") % 4).cast("string")))
    label = alerts.label(p, F.col("task_id") % 101, F.when(k == 3, F.col("minutes") + 1).otherwise(1), k == 1, k == 0, F.col("created_at"))
    return T.tasks(spark, sf_dir).select("task_id", label.alias("label"))


@query(
    "alert_templates",
    f"""with {TASKS} select task_id, '## ⚠️ 日志异常告警' || chr(10) || chr(10) || '**业务线**: line ' || line_id || chr(10) || '**站点**: ' || case when task_id % 3 = 0 then 'shop.example' when task_id % 3 = 1 then 'host-1' else '未知' end || chr(10) || case line_id % 3 when 0 then '**环境**: 🔴 正式环境' || chr(10) when 1 then '**环境**: 🟡 测试环境' || chr(10) else '' end
    || '**语言**: ' || case line_id % 2 when 0 then 'C#' else 'rust' end || chr(10) || '**时间范围**: ' || strftime(created_at, '%Y-%m-%d') || chr(10) || '**异常日志数**: ' || log_count || ' 条' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**异常摘要**:' || chr(10) || repeat(task_type, 300)[1:1500] || chr(10) || chr(10) || '---' || chr(10) || '> 请及时排查处理。登录 日志 平台查看完整日志。' as alert,
    '## ' || case task_type when 'alert_triggered' then '🔴' when 'manual' then '🔵' else '⚪' end || ' 日志 AI 分析告警' || chr(10) || chr(10) || '**告警级别**: ' || case task_type when 'alert_triggered' then 'CRITICAL' when 'manual' then 'INFO' else 'NONE' end || chr(10) || '**业务线**: line ' || line_id || chr(10) || '**站点**: 未知' || case line_id % 3 when 0 then ' (正式环境)' when 1 then ' (测试环境)' else '' end || chr(10)
    || '**分析日志数**: ' || log_count || ' 条' || chr(10) || '**任务ID**: ' || task_id::varchar[1:8] || '...' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**AI 分析结论**:' || chr(10) || status || chr(10) || chr(10) || '---' || chr(10) || '> 请及时处理。登录 日志 平台查看完整分析报告。' as analysis,
    '## 🛑 AI 分析流程异常' || chr(10) || chr(10) || '**业务线**: line ' || line_id || chr(10) || '**站点**: 未知' || chr(10) || '**任务ID**: ' || task_id::varchar[1:8] || '...' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**错误信息**:' || chr(10) || '```' || chr(10) || status || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) || '> ⚠️ 分析管道执行未能完成' || chr(10)
    || '> 请检查报错查明是基础设施依赖（如 ElasticSearch、网络等）故障，还是 AI 模型调用异常。' || chr(10) || '> 当前该业务线的错误日志将仅通过原始日志摘要通知。' as failure from tasks""".replace("task_id::varchar[1:8]", "(task_id::varchar)[1:8]"),
)
def alert_templates(spark, sf_dir):
    t, none = T.tasks(spark, sf_dir), F.lit(None).cast("string")
    line = F.concat(F.lit("line "), F.col("line_id").cast("string"))
    branch = F.when(F.col("line_id") % 3 == 0, "master").when(F.col("line_id") % 3 == 1, "develop").otherwise("feature")
    domain, host = F.when(F.col("task_id") % 3 == 0, "shop.example"), F.when(F.col("task_id") % 3 == 1, "host-1").otherwise("")
    severity = F.when(F.col("task_type") == "alert_triggered", "critical").when(F.col("task_type") == "manual", "info").otherwise("none")
    return t.select(
        "task_id",
        alerts.error_alert(line, domain, branch, host, F.when(F.col("line_id") % 2 == 0, "csharp").otherwise("rust"), F.col("log_count"), F.repeat("task_type", F.lit(300)), F.date_format("created_at", "yyyy-MM-dd")).alias("alert"),
        alerts.analysis_alert(line, none, branch, none, severity, F.col("status"), F.col("task_id"), F.col("log_count")).alias("analysis"),
        alerts.failure_alert(line, none, F.col("status"), F.col("task_id")).alias("failure"),
    )


@query(
    "answer_grades",
    """with a as (select doc_id, (case doc_id % 5 when 0 then 'Root cause: ' when 1 then 'looks normal, check the logs. ' when 2 then 'fix the dependency and verify null, impact. ' when 3 then '' else '检查参数。解决方案: ' end || case when doc_id % 7 = 0 then '' else text end) as t, doc_id % 10 / 10.0 as c, doc_id % 6 as logs from documents),
    p as (select *, length(trim(t)) as n, contains(lower(t), 'looks normal')::int + contains(lower(t), 'check the logs')::int as generic,
     regexp_matches(t, '(?i)(?:fix|patch|upgrade|update).*(?:version|dependency)')::int + regexp_matches(t, '(?i)(?:检查|verify|确认).*(?:空值|null|参数|parameter|权限|permission)')::int + regexp_matches(t, '(?i)(?:code).*(?:line|file)')::int + regexp_matches(t, '(?i)root cause')::int + regexp_matches(t, '(?i)(?:impact|scope)')::int + regexp_matches(t, '(?i)(?:recommendation|solution|解决方案)')::int as advice from a where t is not null),
    s as (select *, case when t = '' then 0 else least(100, case when n >= 200 then 30 when n >= 50 then floor(15 + 15 * (n - 50) / 150) else floor(15 * n / 50) end + case generic when 0 then 25 when 1 then 15 else 5 end + case when advice >= 3 then 25 when advice >= 1 then 15 else 5 end + case when c >= 0.8 then 20 when c >= 0.5 then 12 else 5 end)::int end as score from p)
    select doc_id, score::int as score, case when score >= 70 then 'high' when score >= 40 then 'medium' else 'low' end as grade, t = '' or score < 40 and logs >= 3 as retry from s""",
)
def answer_grades(spark, sf_dir):
    d, k = T.table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    head = F.when(k == 0, "Root cause: ").when(k == 1, "looks normal, check the logs. ").when(k == 2, "fix the dependency and verify null, impact. ").when(k == 3, "").otherwise("检查参数。解决方案: ")
    rows = d.select("doc_id", F.concat(head, F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))).alias("t")).where("t is not null")
    return rows.select("doc_id", alerts.graded(F.col("t"), F.col("doc_id") % 10 / 10, F.col("doc_id") % 6).alias("g")).select("doc_id", "g.*")


@query("log_histogram_1m", f"with {LOGS}, b as (select unnest(range(timestamp '2024-01-15 07:00:00', timestamp '2024-01-15 09:00:00', interval 1 minute)) as bucket), c as (select date_trunc('minute', ts) as bucket, count(*) as n from logs where level = 'ERROR' group by 1) select bucket, coalesce(n, 0) as count from b left join c using (bucket)")
def log_histogram_1m(spark, sf_dir):
    """Errors by the minute, with rows of 0 up to both ends of the time asked for."""
    low, high = datetime.datetime(2024, 1, 15, 7), datetime.datetime(2024, 1, 15, 8, 59)
    rows = T.logs(spark, sf_dir).where(search.between(F.col("ts"), low, high + datetime.timedelta(minutes=1), False) & (F.col("level") == "ERROR"))
    return timeseries.fill(timeseries.histogram(rows, "1 minute"), "1 minute", low, high)


@query("line_sections", f"with {RESULTS}, d as (select distinct severity, content from results), r as (select *, row_number() over (partition by severity order by content) as place from d) select severity, 'Known patterns' || chr(10) || string_agg('- ' || content, chr(10) order by content) as section from r where place <= 20 group by 1")
def line_sections(spark, sf_dir):
    rows = T.results(spark, sf_dir).select("severity", "content").distinct()
    return reports.section("Known patterns", rows, ["severity"], F.col("content"), "content")


@query(
    "related_line_errors",
    f"""with {LOGS}, {EDGES}, a as (select line, up as related, 0 as k from e union all select up, line, 1 from e), r as (select *, row_number() over (partition by line order by k, related) as place from a),
    g as (select r.line::bigint as line_id, related::bigint as related, case when e.up is null then 'downstream' else 'upstream' end as direction from r left join e on e.line = r.line and e.up = r.related where place <= 6),
    l as (select *, user_id % 25 as line, row_number() over (partition by user_id % 25 order by ts desc, log_id desc) as place from logs where level = 'ERROR' and ts between timestamp '2024-01-20 03:55:00' and timestamp '2024-01-21 00:05:00'),
    s as (select line, count(*) as errors, array_to_string(list(message[1:300] order by place) filter (place <= 5), chr(10)) as samples from l where place <= 10 group by 1)
    select line_id, related, direction, errors, samples from g join s on s.line = g.related""",
)
def related_line_errors(spark, sf_dir):
    """Errors of the lines that a line's deliveries connect it with, six at most, in a window widened by five minutes."""
    edges = related_lines(spark, sf_dir).select("line_id", "related", "direction")
    errors = T.logs(spark, sf_dir).where("level = 'ERROR'").select("log_id", "ts", (F.col("user_id") % 25).alias("line"), "message")
    out = tools.related_errors(edges, errors, datetime.datetime(2024, 1, 20, 4), datetime.datetime(2024, 1, 21))
    return out.withColumn("samples", F.array_join("samples", "\n"))


@query("pipeline_levels", f"with {LOGS} select log_id, case log_id % 5 when 0 then level when 1 then '' when 2 then 'CRITICAL' when 3 then case log_id % 8 when 1 then 'ERROR' when 2 then 'WARNING' when 3 then 'WARNING' when 4 then 'INFO' when 5 then 'DEBUG' else 'UNKNOWN' end else case regexp_extract(message, '^\\[(\\w+)\\]', 1) when 'ERROR' then 'ERROR' when 'WARN' then 'WARNING' when 'INFO' then 'INFO' else 'UNKNOWN' end end as level from logs")
def pipeline_levels(spark, sf_dir):
    """A field that is there but empty decides, too; where nothing is stated the level is unknown."""
    k = F.col("log_id") % 5
    filetype = F.when(k == 3, F.get(F.array(*map(F.lit, FILETYPES)), (F.col("log_id") % 8).cast("int")))
    level = X.pipeline_level((F.when(k == 0, F.col("level")), F.when(k == 1, "")), F.when(k == 2, "fatal"), filetype, F.when(k == 4, F.col("message")).otherwise("no level"))
    return T.logs(spark, sf_dir).select("log_id", level.alias("level"))


@query(
    "provider_failover",
    """with a as (select o_orderkey as task_id, p as provider_id, (p * 7 + o_orderkey) % 4 as priority, (o_orderkey + p * 3) % 5 < 2 as ok, p = o_custkey % 6 as preferred, 'by ' || p as answer from orders, (select unnest([0, 1, 2, 3]) as p)),
    r as (select *, row_number() over (partition by task_id order by preferred desc, priority desc, provider_id) as place from a), f as (select task_id, min(place) filter (ok) as place, count(*) as n from r group by 1)
    select f.task_id, provider_id, answer, coalesce(f.place, n)::int as tried from f left join r on r.task_id = f.task_id and r.place = f.place""",
)
def provider_failover(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), "o_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("provider_id"))
    p, t = F.col("provider_id"), F.col("task_id")
    asked = o.select("task_id", "provider_id", "o_custkey", ((p * 7 + t) % 4).alias("priority"), ((t + p * 3) % 5 < 2).alias("ok"), F.concat(F.lit("by "), p.cast("string")).alias("answer"))
    return reports.failover(asked, p == F.col("o_custkey") % 6)


@query("processing_time", "select count(*) as tasks, round(avg(epoch_us(o_orderdate::timestamp + to_minutes((o_orderkey % 7 + 1)::int) + to_seconds((o_orderkey % 50)::int)) - epoch_us(o_orderdate::timestamp)) / 1e6 / 60, 1) as mean_minutes from orders where o_orderstatus = 'F' and o_orderkey % 3 > 0")
def processing_time(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    end = F.when(F.col("o_orderkey") % 3 > 0, start + F.make_dt_interval(mins=(F.col("o_orderkey") % 7 + 1).cast("int"), secs=(F.col("o_orderkey") % 50).cast("decimal(18,6)")))
    return dashboard.processing_minutes(o.select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"), start.alias("started_at"), end.alias("completed_at")))


@query("tool_usage_of_tasks", f"with {TASKS}, {CALLS}, c as (select calls.* from calls join tasks using (task_id) where created_at >= timestamp '1995-01-01') select tool, count(*) as calls, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, (sum(duration_ms) // count(*))::bigint as avg_ms, (sum(result_length) // count(*))::bigint as avg_length from c group by 1")
def tool_usage_of_tasks(spark, sf_dir):
    """Calls of the tasks created since a day."""
    recent = T.tasks(spark, sf_dir).where(F.col("created_at") >= F.lit(datetime.datetime(1995, 1, 1))).select("task_id")
    return dashboard.tool_usage(T.tool_calls(spark, sf_dir).join(recent, "task_id"))


@query("feedback_of_recent", f"with {TASKS}, {RESULTS} select severity, count(*) as results, sum(feedback)::bigint as feedback from results where task_id in (select task_id from tasks where created_at >= timestamp '1997-01-01' and line_id = 3) group by 1")
def feedback_of_recent(spark, sf_dir):
    """Results of a line's recent tasks, by a semi join."""
    recent = T.tasks(spark, sf_dir).where((F.col("created_at") >= F.lit(datetime.datetime(1997, 1, 1))) & (F.col("line_id") == 3)).select("task_id")
    return T.results(spark, sf_dir).join(recent, "task_id", "left_semi").groupBy("severity").agg(F.count("*").alias("results"), F.sum("feedback").alias("feedback"))


@query("alert_buckets", f"with {TASKS} select date_trunc('month', created_at)::timestamp as bucket, count(*) as count from tasks where task_type = 'alert_triggered' group by 1")
def alert_buckets(spark, sf_dir):
    a = T.tasks(spark, sf_dir).where("task_type = 'alert_triggered'")
    return a.groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("count"))


@query("weekly_digest", f"with {TASKS}, {RESULTS}, k as (select task_id, count(*) as critical from results where severity = 'critical' group by 1), w as (select *, date_trunc('week', created_at)::timestamp as week from tasks) select week, {MEASURES}, coalesce(sum(critical), 0)::bigint as critical, round(100.0 * count(*) filter (status = 'completed') / count(*), 1)::double as success_rate from w left join k using (task_id) group by 1")
def weekly_digest(spark, sf_dir):
    return dashboard.period_digest(T.tasks(spark, sf_dir), T.results(spark, sf_dir), "week")


@query("tasks_page", f"with {TASKS}, t as (select * from tasks where line_id = 4 and status = 'completed'), n as (select count(*) as total from t) select task_id, created_at, total, ceil(total / 20.0)::bigint as pages from t, n order by created_at desc, task_id limit 20 offset 40")
def tasks_page(spark, sf_dir):
    """The third page of a line's completed tasks, with how many there are."""
    rows = T.tasks(spark, sf_dir).withColumnRenamed("task_id", "id")
    page, total, pages = snapshots.page(rows, 40, 20, line_id=4, status="completed")
    return page.select(F.col("id").alias("task_id"), "created_at", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"))


@query("index_listing", f"with {LOGS} select distinct case service % 3 when 0 then '.ds-app-' when 1 then '.sys-' else 'app-' end || service as name from logs where service % 3 <> 1")
def index_listing(spark, sf_dir):
    """Names that begin with a dot are hidden, but for data streams."""
    kind = F.when(F.col("service") % 3 == 0, ".ds-app-").when(F.col("service") % 3 == 1, ".sys-").otherwise("app-")
    return T.index_listing(T.logs(spark, sf_dir).select(F.concat(kind, F.col("service").cast("string")).alias("name")).distinct())


@query("known_issue", "select vec_id as id, label from embeddings where vec_id = 42")
def known_issue(spark, sf_dir):
    return tools.known_issue(T.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").select("id", "label", "embedding"), 42)


@query("stacks_embedded", f"with {LOGS} select level, count(*) as n from logs where contains(message, chr(10) || '  at ') group by 1")
def stacks_embedded(spark, sf_dir):
    return T.logs(spark, sf_dir).where(X.has_stack(F.col("message"))).groupBy("level").agg(F.count("*").alias("n"))


@query("tenant_tasks", f"with {TASKS} select line_id, count(*) as n from tasks where line_id % 3 = 2 group by 1")
def tenant_tasks(spark, sf_dir):
    return T.scoped(T.tasks(spark, sf_dir).withColumn("tenant_id", F.col("line_id") % 3), 2).groupBy("line_id").agg(F.count("*").alias("n"))


@query("newest_of_groups", f"with {LOGS} select service, case when level = 'ERROR' then regexp_extract(message, '([\\w.]+Exception)', 1) else level end as kind, max_by(log_id, (ts, log_id)) as log_id from logs group by 1, 2")
def newest_of_groups(spark, sf_dir):
    kind = F.when(F.col("level") == "ERROR", X.exception_class(F.col("message"))).otherwise(F.col("level"))
    return T.logs(spark, sf_dir).groupBy("service", kind.alias("kind")).agg(F.max(F.struct("ts", "log_id"))["log_id"].alias("log_id"))


@query("signals_united", "select signal, min(k) as rank from (select unnest(['Caused by:', 'SQLException']) as signal, 0 as k union all select distinct event_type, 1 from events) group by 1")
def signals_united(spark, sf_dir):
    """Fixed signals first, then learned ones; the first of equal ones counts."""
    fixed = spark.createDataFrame([("Caused by:", 0), ("SQLException", 0)], "signal string, rank int")
    learned = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), F.lit(1).alias("rank")).distinct()
    return timeseries.union_all([fixed, learned]).groupBy("signal").agg(F.min("rank").alias("rank"))


@query(
    "signature_branches",
    f"""with {LOGS} select log_id, case log_id % 3 when 0 then 'EXCEPTIONS: ' || case when level = 'ERROR' then array_to_string(list_sort(['b.OtherError', regexp_extract(message, '([\\w.]+Exception)', 1)]), ', ') || ' | STACK: ' || regexp_extract(message, 'at\\s+([\\w.$]+)\\(', 1) || ' → x.Y.run' else 'b.OtherError | STACK: x.Y.run' end
    when 1 then 'ERRORS: first ' || log_id || ' | second | third' else ('calm ' || repeat(event_type, 99))[1:300] end as signature from logs""",
)
def signature_branches(spark, sf_dir):
    """Texts with classes and frames, two of them on one line; with error lines only; and with neither."""
    k = F.col("log_id") % 3
    classes = F.concat("message", F.lit("\nCaused by: b.OtherError: z\n at x.Y.run(Y.java:1) at second.On.line(Z.java:2)\n at x.Y.run(Y.java:9)"))
    lines = F.concat(F.lit("[2024-01-01] [ERROR] first "), F.col("log_id").cast("string"), F.lit("\nplain\n[a] [ERROR] [b] second\n[a] [FATAL] third\n[a] [ERROR] fourth"))
    calm = F.concat(F.lit("calm "), F.repeat("event_type", F.lit(99)))
    return T.logs(spark, sf_dir).select("log_id", X.error_signature(F.when(k == 0, classes).when(k == 1, lines).otherwise(calm)).alias("signature"))


@query("fingerprint_branches", f"with {LOGS} select case when event_id % 2 = 0 then 'fp:' || service || ':a.b.KindError:' || md5('a.b.KindError: x ' || event_id % 9)[1:12] else 'fp:' || service || ':' || md5(('line ' || repeat(event_id % 9, 300))[1:200])[1:16] end as fingerprint, count(*) as n from (select *, log_id as event_id from logs) group by 1".replace("|| event_id % 9)", "|| (event_id % 9))").replace("repeat(event_id % 9,", "repeat((event_id % 9)::varchar,"))
def fingerprint_branches(spark, sf_dir):
    """Messages with an exception class, and long ones without."""
    k = (F.col("log_id") % 9).cast("string")
    text = F.when(F.col("log_id") % 2 == 0, F.concat(F.lit("a.b.KindError: x "), k, F.lit("\n at q"))).otherwise(F.concat(F.lit("line "), F.repeat(k, F.lit(300))))
    return T.logs(spark, sf_dir).groupBy(X.fingerprint(F.col("service").cast("string"), text, "fp:").alias("fingerprint")).agg(F.count("*").alias("n"))


@query("vectors_stored", "select vec_id::varchar as doc_id, label::varchar as kb_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 4) as length from embeddings")
def vectors_stored(spark, sf_dir):
    """Chunks appended in two batches, one of them twice, and read back."""
    folder = scratch.scratch(spark, "chunks")
    e = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("kb_id"), "embedding", "vec_id")
    vectors.create(spark, folder, dimension=64)
    for name, rows in (("a", e.where("vec_id % 2 = 0")), ("b", e.where("vec_id % 2 = 1")), ("a", e.where("vec_id % 2 = 0"))):
        vectors.append(rows, folder, name)
    return vectors.read(spark, folder).select("doc_id", "kb_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x), 4).alias("length"))


@query(
    "trend_alerts",
    f"""with {TASKS} select line_id, '## ' || case when count(*) > 60 then '🔴' else '🟡' end || ' 错误趋势预警' || chr(10) || chr(10) || '**业务线**: line ' || line_id || chr(10) || '**加速倍率**: ' || printf('%.1f', count(*) / 10.0) || 'x (阈值: 3.0x)' || chr(10) || '**最近窗口错误数**: ' || count(*) || chr(10) || '**基线平均**: 10' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> ⚠️ 错误率正在加速增长，建议立即排查是否有新发布或基础设施异常。' as alert from tasks where status = 'failed' group by line_id""",
)
def trend_alerts(spark, sf_dir):
    n = T.tasks(spark, sf_dir).where("status = 'failed'").groupBy("line_id").agg(F.count("*").alias("n"))
    return n.select("line_id", alerts.trend_alert(F.when(F.col("n") > 60, "critical").otherwise("warning"), F.concat(F.lit("line "), F.col("line_id").cast("string")), F.col("n") / 10, F.lit(3.0), F.col("n"), F.lit(10)).alias("alert"))


@query(
    "history_sections",
    """with i as (select p_brand as line, p_partkey as id, p_size as hits, case when p_partkey % 3 = 0 then 'verified' end as quality, p_partkey % 4 = 1 as resolved, p_name as signature, case when p_partkey % 5 = 0 then '' else p_type || chr(10) || p_brand end as content from part),
    r as (select *, row_number() over (partition by line order by quality desc nulls last, hits desc nulls last, id) as place from i),
    e as (select line, place, place || '. [WARNING' || case when quality = 'verified' then ', 已验证' else '' end || case when resolved then ', 已修复' else '' end || '] ' || signature[1:120] || case when hits > 1 then ' (累计 ' || hits || ' 次)' else '' end || case when content = '' then '' else chr(10) || '   结论: ' || string_split(content, chr(10))[1][1:200] end as t from r where place <= 8)
    select line, '## 该服务的历史分析记录' || chr(10) || '以下是过去分析中的关键发现：' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by place) || chr(10) || chr(10) || '请参考但基于当前日志做独立判断。已修复问题再次出现属于回归。' as section from e group by 1""",
)
def history_sections(spark, sf_dir):
    """Parts as known issues of their brand, eight for each."""
    p, k = T.table(spark, sf_dir, "part"), F.col("p_partkey")
    issues = p.select(F.col("p_brand").alias("line"), k.alias("id"), F.col("p_size").alias("hits"), F.when(k % 3 == 0, "verified").alias("quality"), (k % 4 == 1).alias("resolved"), F.col("p_name").alias("signature"), F.when(k % 5 == 0, "").otherwise(F.concat("p_type", F.lit("\n"), "p_brand")).alias("content"), F.lit(None).cast("timestamp").alias("last_seen"))
    best = reports.known_issues(issues, 8, "line").withColumns({"severity": F.lit("warning"), "verified": F.col("quality") == "verified"})
    return alerts.history_sections(best, "line")


@query(
    "correlation_sections",
    """with e as (select n_regionkey as line_id, n_name as name, case when n_nationkey % 2 = 0 then 'upstream' else 'downstream' end as direction, n_nationkey + 1 as errors from nation),
    b as (select *, '### ' || case direction when 'upstream' then '上游服务' else '下游服务' end || ': ' || name || ' (' || errors || ' 条错误)' || chr(10) || '  1. ' || name || chr(10) || '  2. b' || chr(10) || '  3. c' || chr(10) as t from e where name in (select n_name from customer join nation on c_nationkey = n_nationkey))
    select line_id, chr(10) || chr(10) || '## 跨服务关联异常' || chr(10) || '以下关联服务在同一时间窗口内也出现了错误，请综合分析是否存在级联故障：' || chr(10) || chr(10) || string_agg(t, chr(10) order by direction = 'downstream', name) as section from b group by 1""",
)
def correlation_sections(spark, sf_dir):
    """Nations with customers as services that failed, by region."""
    n = T.table(spark, sf_dir, "nation").join(T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    found = n.select(F.col("n_regionkey").alias("line_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "upstream").otherwise("downstream").alias("direction"), (F.col("n_nationkey") + 1).alias("errors"), F.array("n_name", F.lit("b"), F.lit("c"), F.lit("d")).alias("samples"))
    return alerts.correlation_sections(found, "line_id")


@query(
    "change_sections",
    f"""with {LOGS}, c as (select service, date_trunc('day', ts) as bucket, count(*) as n from logs group by 1, 2), r as (select *, row_number() over (partition by service order by bucket) as place from c where n % 2 = 0)
    select service, chr(10) || chr(10) || '## 错误率变点检测' || chr(10) || '整体趋势: **stable**' || chr(10) || chr(10) || '以下时间点检测到统计显著的错误率突变：' || chr(10) || chr(10) || string_agg('- **' || strftime(bucket, '%Y-%m-%d %H:%M:%S') || '**: 错误率从 1/min 突增到 ' || n || '/min (z-score=3, 当前桶=' || n || '条)', chr(10) order by bucket) || chr(10) || chr(10) || '请结合以上错误率变化分析是否与部署、配置变更或流量突增有关。' as section from r where place <= 5 group by 1""",
)
def change_sections(spark, sf_dir):
    """Days with an even number of logs as the points of a service."""
    days = timeseries.histogram(T.logs(spark, sf_dir), "1 day", "service").where("count % 2 = 0")
    points = days.withColumns({"trend": F.lit("stable"), "z": F.lit(3), "before_rate": F.lit(1), "after_rate": F.col("count")})
    return alerts.change_sections(points, "service")
