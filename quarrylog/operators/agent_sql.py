"""What an investigating agent may ask, as SQL functions that return tables: SELECT * FROM search_logs('timeout', ...).

register makes temporary functions over temporary views of the tables that it is given. Their bodies are SQL, so a call is a plain subquery that Catalyst sees
through: filters and column choices reach the scans, and calls can be joined and aggregated. Sizes are capped as the tools' are. Times that are null leave
the window open; they are arguments, as functions must not look at the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.functions import text as X
from quarrylog.functions import values as V

#: Fixed: how many rows a call gives at most.
LOGS, CONTEXT, PATTERNS, INDICES, SIMILAR, CROSS_INDICES, CROSS_LOGS = 50, 50, 50, 100, 5, 5, 10
RANK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.LEVEL_RANK.items())
COSINE = "try_divide(aggregate(zip_with(cast(v AS ARRAY<DOUBLE>), cast(q AS ARRAY<DOUBLE>), (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(cast(v AS ARRAY<DOUBLE>), 0D, (s, x) -> s + x * x)) * sqrt(aggregate(cast(q AS ARRAY<DOUBLE>), 0D, (s, x) -> s + x * x)))"

FUNCTIONS = {
    "search_logs": f"""(query STRING, low TIMESTAMP, high TIMESTAMP, level_is STRING DEFAULT NULL, size INT DEFAULT 20)
        RETURNS TABLE(log_id BIGINT, ts TIMESTAMP, level STRING, service STRING, message STRING) RETURN
        SELECT log_id, ts, level, service, left(message, 500) FROM
        (SELECT *, row_number() OVER (ORDER BY ts DESC, log_id DESC) AS place FROM agent_logs
         WHERE ts >= coalesce(search_logs.low, ts) AND ts <= coalesce(search_logs.high, ts) AND (search_logs.level_is IS NULL OR upper(level) = upper(search_logs.level_is))
         AND (coalesce(search_logs.query, '') = '' OR contains(lower(message), lower(search_logs.query)))) WHERE place <= least(greatest(search_logs.size, 1), {LOGS})""",
    "get_log_context": f"""(at TIMESTAMP, minutes INT DEFAULT 5, least_level STRING DEFAULT 'WARNING')
        RETURNS TABLE(log_id BIGINT, ts TIMESTAMP, level STRING, service STRING, message STRING) RETURN
        SELECT log_id, ts, level, service, left(message, 500) FROM
        (SELECT *, row_number() OVER (ORDER BY ts, log_id) AS place FROM agent_logs
         WHERE ts BETWEEN get_log_context.at - make_dt_interval(0, 0, get_log_context.minutes) AND get_log_context.at + make_dt_interval(0, 0, get_log_context.minutes)
         AND (CASE upper(level) {RANK} ELSE 0 END) >= (CASE upper(get_log_context.least_level) {RANK} ELSE 0 END)) WHERE place <= {CONTEXT}""",
    "count_error_patterns": f"""(low TIMESTAMP, high TIMESTAMP, group_by STRING DEFAULT 'pattern')
        RETURNS TABLE(key STRING, n BIGINT) RETURN
        SELECT key, n FROM (SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM
        (SELECT CASE count_error_patterns.group_by WHEN 'service' THEN service WHEN 'time' THEN cast(window.start AS STRING) ELSE pattern END AS key FROM
         (SELECT *, window(ts, '5 minutes') AS window FROM agent_logs WHERE upper(level) = 'ERROR' AND ts >= coalesce(count_error_patterns.low, ts) AND ts <= coalesce(count_error_patterns.high, ts))) GROUP BY key) WHERE place <= {PATTERNS}""",
    "list_available_indices": f"""(pattern STRING DEFAULT '*')
        RETURNS TABLE(name STRING, docs BIGINT) RETURN
        SELECT name, docs FROM (SELECT *, row_number() OVER (ORDER BY name) AS place FROM agent_indices
         WHERE (NOT startswith(name, '.') OR startswith(name, '.ds-')) AND name LIKE replace(list_available_indices.pattern, '*', '%')) WHERE place <= {INDICES}""",
    "search_knowledge_base": f"""(q ARRAY<DOUBLE>, least DOUBLE DEFAULT 0.5, k INT DEFAULT 3)
        RETURNS TABLE(chunk_id BIGINT, content STRING, score DOUBLE) RETURN
        SELECT chunk_id, left(content, 500), round(score, 6) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM
        (SELECT chunk_id, content, {COSINE.replace(" q ", " search_knowledge_base.q ").replace("cast(q ", "cast(search_knowledge_base.q ")} AS score FROM agent_chunks) WHERE score >= search_knowledge_base.least)
        WHERE place <= least(search_knowledge_base.k, {SIMILAR})""",
    "search_similar_incidents": f"""(q ARRAY<DOUBLE>, k INT DEFAULT 3)
        RETURNS TABLE(issue_id BIGINT, severity STRING, content STRING, score DOUBLE) RETURN
        SELECT issue_id, severity, left(content, 500), round(score, 6) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, issue_id) AS place FROM
        (SELECT issue_id, severity, content, {COSINE.replace("cast(q ", "cast(search_similar_incidents.q ")} AS score FROM agent_issues) WHERE score IS NOT NULL)
        WHERE place <= least(search_similar_incidents.k, {SIMILAR})""",
    "search_cross_service_logs": f"""(keyword STRING, own STRING, low TIMESTAMP, high TIMESTAMP, service_is STRING DEFAULT NULL)
        RETURNS TABLE(log_id BIGINT, ts TIMESTAMP, service STRING, message STRING) RETURN
        SELECT log_id, ts, service, left(message, 200) FROM (SELECT l.*, row_number() OVER (ORDER BY l.ts DESC, l.log_id DESC) AS place FROM agent_logs l JOIN
         (SELECT name, row_number() OVER (ORDER BY name) AS nth FROM agent_indices WHERE NOT startswith(name, '.')
          AND NOT exists(split(search_cross_service_logs.own, ','), p -> replace(trim(p), '*', '') <> '' AND startswith(name, replace(trim(p), '*', '')))
          AND (search_cross_service_logs.service_is IS NULL OR contains(lower(name), lower(search_cross_service_logs.service_is)))) i ON l.index_name = i.name AND i.nth <= {CROSS_INDICES}
         WHERE upper(l.level) = 'ERROR' AND l.ts >= coalesce(search_cross_service_logs.low, l.ts) AND l.ts <= coalesce(search_cross_service_logs.high, l.ts)
         AND contains(lower(l.message), lower(search_cross_service_logs.keyword))) WHERE place <= {CROSS_LOGS}""",
}


def register(spark: SparkSession, logs: DataFrame, indices: DataFrame, chunks: DataFrame, issues: DataFrame) -> list[str]:
    """Makes the functions; returns their names. logs: log_id, ts, level, service, message, index_name; indices: name, docs; chunks: chunk_id, content, v; issues: issue_id, severity, content, v."""
    logs.selectExpr("log_id", "cast(ts AS TIMESTAMP) AS ts", "level", "cast(service AS STRING) AS service", "message", "index_name").withColumn("pattern", X.group_key(logs["message"])).createOrReplaceTempView("agent_logs")
    indices.createOrReplaceTempView("agent_indices")
    chunks.createOrReplaceTempView("agent_chunks")
    issues.createOrReplaceTempView("agent_issues")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
