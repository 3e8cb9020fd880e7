"""The registered log-analysis queries and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tables of quarrylog.sources.tables in SQL.
LEVEL = "case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' when 'signup' then 'INFO' else 'DEBUG' end"
LOGS = f"""logs as (select event_id as log_id, ts, {LEVEL} as level, user_id % 8 as service, user_id, event_type, value,
 case event_type when 'error' then '[ERROR] java.lang.' || ['IllegalStateException', 'NullPointerException', 'TimeoutException', 'SQLException'][(event_id % 4 + 1)::int] || ': request ' || event_id || ' failed for user ' || user_id || chr(10) || '  at com.app.Service' || user_id % 3 || '.run(Service.java:' || event_id % 90 + 10 || ')'
 when 'purchase' then '[WARN] {{"status": true, "order": ' || event_id || '}}' else (case event_type when 'signup' then '[INFO] ' else '[ERROR] ' end) || 'request ' || event_id || ' served in ' || event_id % 300 + 1000 || ' ms' end as message from events)""".replace("event_id % 90 + 10", "(event_id % 90 + 10)").replace("user_id % 3 ||", "(user_id % 3) ||").replace("event_id % 300 + 1000", "(event_id % 300 + 1000)")
TASKS = """tasks as (select o_orderkey as task_id, o_custkey % 20 as line_id, case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'pending' end as status,
 case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'alert_triggered' when o_orderpriority like '3%' then 'manual' else 'scheduled' end as task_type,
 case when o_orderkey % 5 = 0 then 0 else floor(o_totalprice)::bigint end as tokens, case when o_orderkey % 15 = 0 then 'skipped: 质量过滤' when o_orderkey % 10 = 0 then 'skipped: 指纹去重' end as error_message,
 o_orderdate as created_at, o_orderkey % 7 + 1 as minutes, round(o_totalprice / 100)::bigint as log_count from orders)"""
RESULTS = """results as (select l_orderkey * 10 + l_linenumber as result_id, l_orderkey as task_id, case l_returnflag when 'R' then 'critical' when 'A' then 'warning' else 'info' end as severity, l_discount * 10 as confidence,
 case l_linenumber % 3 when 1 then 1 when 2 then -1 end as feedback, 'pattern ' || l_partkey % 50 as content from lineitem)""".replace("l_partkey % 50", "(l_partkey % 50)")
CALLS = "calls as (select conv_id as task_id, turn as step, role as tool, length(text) as result_length, length(text) * 3 as duration_ms, length(text) % 7 <> 0 as success from conversations)"
LINES = "lines as (select n_nationkey::bigint as line_id, n_name as name, n_nationkey % 10 + 1 as weight, n_regionkey = 1 as core from nation)"
MEASURES = "count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, coalesce(sum(tokens), 0)::bigint as tokens, coalesce(sum(log_count), 0)::bigint as logs"
IDLE = "status = 'completed' and tokens = 0"
SKIPS = f"""count(*) filter ({IDLE} and coalesce(error_message, '') like '%质量过滤%') as quality_filtered, count(*) filter ({IDLE} and coalesce(error_message, '') like '%指纹去重%') as fingerprint_skipped,
 count(*) filter ({IDLE} and coalesce(error_message, '') not like '%质量过滤%' and coalesce(error_message, '') not like '%指纹去重%') as semantic_dedup"""


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
