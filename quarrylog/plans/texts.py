"""Queries over messages, documents and vectors: search, levels, filters, signatures, masks, chunks, neighbours, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V
from quarrylog.operators import dedup as U
from quarrylog.operators import prefixes, sampling, vector
from quarrylog.operators import search as Q
from quarrylog.plans.registry import LOGS, query
from quarrylog.sources import tables as T


def has(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def matches(column: str, patterns) -> str:
    quoted = ["regexp_matches({}, '{}')".format(column, p.replace("'", "''")) for p in patterns]
    return "(" + " or ".join(quoted) + ")"


@query("log_search_error", f"with {LOGS} select log_id, ts, level, message from logs where level = 'ERROR' or {has('message', V.ERROR_MARKERS + V.STATIC_SIGNALS)} order by ts desc, log_id desc limit 5000")
def log_search_error(spark, sf_dir):
    rows = T.logs(spark, sf_dir)
    none = F.lit("")
    return Q.search(rows, Q.severity_filter("error", [F.lower("level")], F.col("level"), none, F.col("message"))).select("log_id", "ts", "level", "message")


@query("log_search_warning", f"with {LOGS} select log_id, ts, level, message from logs where level = 'WARNING' or {has('message', V.WARNING_MARKERS)} order by ts desc, log_id desc limit 5000")
def log_search_warning(spark, sf_dir):
    return Q.search(T.logs(spark, sf_dir), Q.severity_filter("warning", [F.lower("level")], F.col("level"), F.lit(""), F.col("message"))).select("log_id", "ts", "level", "message")


@query("log_search_text", "select doc_id, lang, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license')")
def log_search_text(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    return d.where(Q.text_filter("license", F.col("text"), F.col("source"))).select("doc_id", "lang", "source")


@query("log_filter_fields", f"with {LOGS} select log_id, service, user_id from logs where service = 3 and event_type like 'c%k' and ts between timestamp '2024-01-05' and timestamp '2024-01-20'")
def log_filter_fields(spark, sf_dir):
    import datetime

    rows = T.logs(spark, sf_dir)
    where = (F.col("service") == 3) & Q.wildcard(F.col("event_type"), "c*k") & Q.between(F.col("ts"), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20))
    return rows.where(where).select("log_id", "service", "user_id")


@query("log_stats_level", f"with {LOGS} select level as value, count(*) as n from logs group by 1 order by n desc, value limit 10")
def log_stats_level(spark, sf_dir):
    return Q.terms(T.logs(spark, sf_dir), F.col("level"), 10, "unknown")


@query("log_stats_service", f"with {LOGS} select user_id::varchar as value, count(*) as n from logs where level = 'ERROR' group by 1 order by n desc, value limit 50")
def log_stats_service(spark, sf_dir):
    return Q.terms(T.logs(spark, sf_dir).where("level = 'ERROR'"), F.col("user_id"), 50)


@query("level_normalize", "select event_id, case event_type when 'error' then 'critical' when 'purchase' then 'warning' when 'signup' then 'info' when 'click' then 'debug' else 'view' end as level from events")
def level_normalize(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", "FATAL").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "signup", "Information").when(F.col("event_type") == "click", " trace ").otherwise("VIEW")
    return T.table(spark, sf_dir, "events").select("event_id", X.normalize_level(raw).alias("level"))




@query(
    "quality_filter_reasons",
    f"""with {LOGS}, a as (select log_id, upper(nullif(regexp_extract(message, '{V.LEVEL_PATTERNS[0]}', 1), '')) as lv, {matches("message", V.REAL_ERRORS)} as strong, {has("message", V.FAULT_WORDS)} as word, {" + ".join(f"regexp_matches(message, '{p}')::int" for p in V.NOISE)} as signs,
    regexp_matches(message, '(?i)exception|error|fail|timeout|refused') or contains(message, '异常') or contains(message, '失败') as doubt from logs),
    b as (select log_id, case when lv in ('TRACE', 'DEBUG', 'INFO', 'WARN', 'WARNING') and not (strong or word) then 'level' when signs >= 2 or (signs = 1 and not doubt) then 'noise' when lv = 'ERROR' and not strong then 'shallow' end as reason from a)
    select reason, count(*) as n, min(log_id) as first_id from b group by 1""",
)
def quality_filter_reasons(spark, sf_dir):
    return T.logs(spark, sf_dir).withColumn("reason", X.drop_reason(F.col("message"), "ERROR")).groupBy("reason").agg(F.count("*").alias("n"), F.min("log_id").alias("first_id"))


@query("stack_merge", f"with {LOGS} select log_id, 1::bigint as seq, len(string_split(message, chr(10)))::bigint as n_lines, message from logs")
def stack_merge(spark, sf_dir):
    """Messages are cut into lines and merged again, so each must come back whole."""
    cut = T.logs(spark, sf_dir).select("log_id", F.posexplode(F.split("message", "\n")).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long") + 1)
    return U.merge_stacks(cut, "log_id").select("log_id", "seq", "n_lines", "message")


@query("keep_first_dedup", "select substr(text, 1, 200) as dedup_key, count(*) as copies, min(doc_id) as doc_id from documents where text is not null group by 1")
def keep_first_dedup(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return U.keep_first(d.withColumn("k", F.substring("text", 1, 200)).drop("text"), F.col("k"), "doc_id").select("dedup_key", "copies", "doc_id")


FP = "'x:' || substr(md5(substr(string_split(text, chr(10))[1], 1, 200)), 1, 16)"


@query("fingerprint_new", f"with f as (select doc_id, {FP} as fingerprint from documents where text <> ''), s as (select fingerprint from f where doc_id % 2 = 0 and doc_id % 3 <> 0) select doc_id, fingerprint from f where fingerprint not in (select fingerprint from s)")
def fingerprint_new(spark, sf_dir):
    """Documents whose fingerprint none of the even documents has; entries of every third have expired."""
    import datetime

    d = T.table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", X.fingerprint(F.lit("x"), F.col("text")).alias("fingerprint"))
    now, later = datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 3)
    seen = d.where("doc_id % 2 = 0").withColumn("expire_at", F.when(F.col("doc_id") % 3 == 0, F.lit(now)).otherwise(F.lit(later)))
    return U.unseen(d, seen.select("fingerprint", "expire_at"), now).select("doc_id", "fingerprint")


@query(
    "group_key_counts",
    f"with {LOGS}, k as (select coalesce(nullif(regexp_extract(message, '([\\w.]+(?:Exception|Error|Throwable|Fault))', 1), ''), substr(regexp_replace(regexp_replace(substr(string_split(message, chr(10))[1], 1, 120), '\\b[0-9a-f]{{8,}}[-0-9a-f]*\\b', '<ID>', 'g'), '\\d+', '<N>', 'g'), 1, 80)) as group_key from logs) select group_key, count(*) as n from k group by 1",
)
def group_key_counts(spark, sf_dir):
    return T.logs(spark, sf_dir).groupBy(X.group_key(F.col("message")).alias("group_key")).agg(F.count("*").alias("n"))


@query("error_signature", f"with {LOGS} select log_id, 'EXCEPTIONS: ' || regexp_extract(message, '([\\w.]+(?:Exception|Error|Throwable|Fault))', 1) || ' | STACK: ' || regexp_extract(message, 'at\\s+([\\w.$]+)\\(', 1) as signature from logs where level = 'ERROR'")
def error_signature(spark, sf_dir):
    return T.logs(spark, sf_dir).where("level = 'ERROR'").select("log_id", X.error_signature(F.col("message")).alias("signature"))


@query("signature_normalize", f"with {LOGS} select log_id, substr(lower(trim(regexp_replace(regexp_replace(regexp_replace(message, ':\\d+', '', 'g'), '\\b\\d{{5,}}\\b', '', 'g'), '\\s+', ' ', 'g'))), 1, 120) as signature from logs")
def signature_normalize(spark, sf_dir):
    return T.logs(spark, sf_dir).select("log_id", X.normalize_signature(F.col("message")).alias("signature"))


@query("mask_email", "select doc_id, regexp_replace(text, '([a-zA-Z0-9._%+-]{1,3})[a-zA-Z0-9._%+-]*(@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})', '\\1****\\2', 'g') as masked from documents where contains(text, '@')")
def mask_email(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.regexp_replace("text", V.EMAIL, "$1****$2").alias("masked"))


def twice(text: str, pattern: str, by: str) -> str:
    """SQL that replaces a pattern between two others, which may be shared by neighbours."""
    one = lambda t: f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return one(one(text))


MASKED = twice("text", r"(^|[^0-9a-fA-F-])(1[3-9]\d)\d{4}(\d{4})($|[^0-9a-fA-F-])", r"\1\2****\3\4")
MASKED = twice(MASKED, r"(^|[^0-9])(\d{6})\d{8}(\d{3}[0-9Xx])($|[^0-9])", r"\1\2********\3\4")
MASKED = f"regexp_replace({MASKED}, '([a-zA-Z0-9._%+-]{{1,3}})[a-zA-Z0-9._%+-]*(@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', '\\1****\\2', 'g')"
MASKED = twice(MASKED, r"(^|[^0-9a-fA-F-])(\d{4})\d{8,11}(\d{4})($|[^0-9a-fA-F-])", r"\1\2********\3\4")


@query("mask_formats", f"select doc_id, {MASKED} as masked from documents")
def mask_formats(spark, sf_dir):
    """Phones, identity cards, addresses and cards by their form, in all texts."""
    return T.table(spark, sf_dir, "documents").select("doc_id", X.mask_formats(F.col("text")).alias("masked"))


@query("mask_sensitive")
def mask_sensitive(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.mask_sensitive(F.col("text")).alias("masked"))


@query("mask_lengths", "with v as (select c_custkey, repeat('abcdefghij', 3)[1:(c_custkey % 25 + 1)] as v from customer) select c_custkey, case when length(v) <= 4 then '****' when length(v) <= 8 then v[1:1] || '****' || right(v, 1) when length(v) <= 16 then v[1:3] || '****' || right(v, 4) else v[1:4] || '****' || right(v, 4) end as masked from v")
def mask_lengths(spark, sf_dir):
    value = F.substring(F.lit("abcdefghij" * 3), F.lit(1), (F.col("c_custkey") % 25 + 1).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.mask_value(value).alias("masked"))


@query("kb_chunks", "select doc_id, i // 800 as chunk, substr(text, i + 1, 1000) as content from (select doc_id, text, unnest(range(0, length(text), 800)) as i from documents where text <> '')")
def kb_chunks(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "content"))
    return d.withColumn("chunk", F.col("chunk").cast("long"))


@query("shortened_results", "select doc_id, case when length(text) > 800 then text[1:350] || chr(10) || chr(10) || '... (' || (length(text) - 550) || ' chars omitted) ...' || chr(10) || chr(10) || right(text, 200) else text end as shown from documents where text is not null")
def shortened_results(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.shorten(F.col("text"), 800, 350, 200).alias("shown"))


@query("cut_texts", "select doc_id, case when length(text) > 3200 then text[1:3200] || chr(10) || '... (truncated)' else text end as shown from documents where text is not null")
def cut_texts(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.cut_with_mark(F.col("text"), 3200).alias("shown"))


@query("kb_duplicates", "select sha256(text) as hash, source, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1, 2 having count(*) > 1")
def kb_duplicates(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("hash"), "source").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("kb_doc_counts", "select s.source, coalesce(n, 0) as documents, coalesce(c, 0)::bigint as characters from (select distinct source from documents) s left join (select source, count(*) as n, sum(n_chars) as c from documents where lang = 'en' group by 1) d using (source)")
def kb_doc_counts(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    own = d.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))
    return d.select("source").distinct().join(own, "source", "left").na.fill(0)


KNN = "with q as (select vec_id as query_id, label as ql, embedding::double[] as q from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id, list_dot_product(q, embedding::double[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) as score from q, embeddings where vec_id <> query_id {where}), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as place from s) select query_id, vec_id, round(score, 6) as score, place from r where place <= {k}"


@query("knn_top3", KNN.format(where="", k=3))
def knn_top3(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector.knn_by_tiles(queries, e.select("vec_id", F.col("embedding").alias("v")), 3, apart=True)


@query("semantic_dedup_hit", KNN.format(where="and label = ql and list_dot_product(q, embedding::double[]) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(embedding::double[], embedding::double[])) >= 0.3", k=1))
def semantic_dedup_hit(spark, sf_dir):
    """The nearest vector of the same line, if it is near enough."""
    e = T.table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return vector.knn_by_tiles(queries, e.select("vec_id", F.col("embedding").alias("v"), "label"), 1, 0.3, "label", True)


@query("ignored_issue_match", "select doc_id, item_id from documents d join benchmark b on contains(d.text, substr(b.text, 1, 80)) or contains(b.text, substr(d.text, 1, 80)) where length(b.text) >= 80 and length(d.text) >= 80")
def ignored_issue_match(spark, sf_dir):
    """Documents and known texts of which one holds the first 80 characters of the other."""
    known = T.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return prefixes.matches(T.table(spark, sf_dir, "documents").select("doc_id", "text"), known)


@query("signals_upsert", "with s as (select event_type || user_id % 20 as signal, ts, (value > 50)::int * 0.2 + 0.6 as confidence from events), o as (select signal, max(confidence) as confidence, count(*) as hits, min(ts) as first_seen, max(ts) as last_seen from s group by 1) select md5(signal) as id, signal, round(confidence, 4)::double as confidence, hits, first_seen, last_seen from o".replace("user_id % 20", "(user_id % 20)"))
def signals_upsert(spark, sf_dir):
    """The first half of the events is the old table, the rest is merged into it."""
    e = T.table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.col("user_id") % 20).alias("signal"), F.round(F.when(F.col("value") > 50, 0.8).otherwise(0.6), 4).alias("confidence"), "ts")
    empty = spark.createDataFrame([], "id string, signal string, confidence double, hits long, first_seen timestamp_ntz, last_seen timestamp_ntz")
    return U.upsert_signals(U.upsert_signals(empty, e.where("event_id % 2 = 0")), e.where("event_id % 2 = 1"))


@query("issue_state_update", "with e as (select user_id as id, count(*) as n, max(ts) as latest from events where event_type = 'error' group by 1), u as (select distinct user_id as id from events) select id, coalesce(n, 0) as hits, latest as last_seen, case when latest is null then timestamp '2024-01-01' else latest + interval 168 hours end as expire_at from u left join e using (id)")
def issue_state_update(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    issues = e.select(F.col("user_id").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("hits"), F.lit(None).cast("timestamp_ntz").alias("last_seen"), F.expr("timestamp_ntz '2024-01-01'").alias("expire_at"))
    return U.hit_issues(issues, e.where("event_type = 'error'").select(F.col("user_id").alias("id"), "ts"))


GROUP_KEY = "coalesce(nullif(regexp_extract(message, '([\\w.]+(?:Exception|Error|Throwable|Fault))', 1), ''), substr(regexp_replace(regexp_replace(substr(string_split(message, chr(10))[1], 1, 120), '\\b[0-9a-f]{8,}[-0-9a-f]*\\b', '<ID>', 'g'), '\\d+', '<N>', 'g'), 1, 80))"
#: The sampler in SQL, over a view src (task, log_id, ts, level, message): slots by least numbers, weighted logarithms and the rest; then turns through groups.
SAMPLE = """, l as (select task, log_id, ts, coalesce(upper(level), 'UNKNOWN') as severity, {key} as grp, md5(substr(message, 1, 500)) as h from src),
n as (select task, severity, count(*) as n, case severity when 'CRITICAL' then 10 when 'FATAL' then 10 when 'ERROR' then 5 when 'WARN' then 2 when 'WARNING' then 2 else 0 end as least0,
 case severity when 'CRITICAL' then 5.0 when 'FATAL' then 5.0 when 'ERROR' then 3.0 when 'WARN' then 1.5 when 'WARNING' then 1.5 when 'INFO' then 0.5 when 'DEBUG' then 0.2 when 'TRACE' then 0.1 else 1.0 end::double as w from l group by 1, 2),
a as (select *, least(n, least0) as s0, sum(n) over t as everything, {budget} - sum(least(n, least0)) over t as remaining, w * log2(n - least(n, least0) + 1) as score from n window t as (partition by task)),
b as (select *, s0 + case when remaining > 0 then least(coalesce(floor(remaining * (score / nullif(sum(score) over (partition by task), 0)))::bigint, 0), n - s0) else 0 end as s1 from a),
c as (select *, {budget} - sum(s1) over (partition by task) as rest, coalesce(sum(n - s1) over (partition by task order by w * n desc, severity rows between unbounded preceding and 1 preceding), 0) as before from b),
k as (select task, severity, n, case when everything <= {budget} then n else s1 + greatest(0, least(n - s1, rest - before)) end as slots from c),
p as (select l.*, slots, n, row_number() over w as turn, first_value(ts) over w as ft, first_value(log_id) over w as fi from l join k using (task, severity) window w as (partition by task, severity, grp order by ts desc, log_id desc)),
o as (select *, row_number() over (partition by task, severity, h order by turn, ft desc, fi desc) as again from p where n > slots),
f as (select *, row_number() over (partition by task, severity order by turn, ft desc, fi desc) as place, dense_rank() over (partition by task, severity order by turn) as round from o where again = 1)
select task, log_id, severity, grp from p where n <= slots union all select task, log_id, severity, grp from f where place <= slots and turn = round"""


@query("adaptive_sample", f"with {LOGS}, src as (select service as task, log_id, ts, level, message from logs)" + SAMPLE.format(key=GROUP_KEY, budget=200).replace("select task, log_id, severity, grp", 'select task as service, log_id, severity, grp as "group"'))
def adaptive_sample(spark, sf_dir):
    return sampling.sample(T.logs(spark, sf_dir), 200, "service")


@query("adaptive_sample_sources", f"with {LOGS}, src as (select event_type as task, log_id, ts, level, message from logs)" + SAMPLE.format(key=GROUP_KEY, budget=60).replace("select task, log_id, severity, grp", 'select task, log_id, severity, grp as "group"'))
def adaptive_sample_sources(spark, sf_dir):
    """Two sources whose documents have other shapes, sampled by one call: levels and messages lie elsewhere in each."""
    rows = T.logs(spark, sf_dir)
    flat = F.to_json(F.struct("level", F.col("message").alias("msg")))
    deep = F.to_json(F.struct(F.struct(F.col("level").alias("severity"), F.array(F.struct(F.col("message").alias("text"))).alias("lines")).alias("log")))
    source = F.when(F.col("service") % 2 == 0, "flat").otherwise("deep")
    docs = rows.select(F.col("event_type").alias("task"), "log_id", "ts", source.alias("source"), F.parse_json(F.when(F.col("service") % 2 == 0, flat).otherwise(deep)).alias("document"))
    level, message = sampling.extracted(F.col("document"), F.col("source"), {"flat": ("$.level", "$.msg"), "deep": ("$.log.severity", "$.log.lines[0].text")})
    return sampling.sample(docs, 60, "task", level=level, message=message)


@query("format_lines", f"with {LOGS} select log_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || level || '] [service:' || service || '] ' || string_split(message, chr(10))[1] as line from logs")
def format_lines(spark, sf_dir):
    rows = T.logs(spark, sf_dir)
    line = X.format_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("level"), F.substring_index("message", "\n", 1), service=F.col("service").cast("string"), pod=F.lit(""))
    return rows.select("log_id", line.alias("line"))


