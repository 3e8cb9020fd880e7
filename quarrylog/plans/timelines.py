"""Queries over logs in time: change points, histograms, baselines, context, windows of alerts and requests."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarrylog.operators import timeseries as S
from quarrylog.plans.registry import LOGS, query
from quarrylog.sources.tables import logs

FILLED = "c as (select date_trunc('hour', ts) as bucket, count(*) as n from events where event_type = 'error' group by 1), f as (select g.bucket, coalesce(n, 0)::bigint as count from (select unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) as bucket from c) g left join c using (bucket))"


def error_series(spark, sf_dir, width="1 hour"):
    return S.fill(S.histogram(logs(spark, sf_dir).where("event_type = 'error'"), width), width)


@query(
    "change_points",
    f"""with {FILLED}, w as (select *, count(*) over p as n, sum(count) over p as s, sum(count * count) over p as s2, avg(count) over (order by bucket rows between current row and 9 following) as after_rate from f window p as (order by bucket rows between 30 preceding and 1 preceding)),
    z as (select *, (count - s / 30) / greatest(sqrt((s2 * 30 - s * s) / 900), 0.5) as z from w where n = 30)
    select bucket, count, round(z, 4) as z, round(s / 30, 4) as before_rate, round(after_rate, 4) as after_rate from z where z >= 3""",
)
def change_points(spark, sf_dir):
    return S.change_points(error_series(spark, sf_dir))


@query(
    "change_trend",
    f"""with {FILLED}, r as (select *, row_number() over (order by bucket) as i, count(*) over () as n from f),
    a as (select n, max(count) as peak, avg(count) filter (i <= n // 3) as f1, avg(count) filter (i > n - n // 3) as f3 from r group by n)
    select n, peak, case when n < 6 then 'unknown' when (f1 > 0 and peak > 5 * f1) or (f1 = 0 and peak > 10) then 'spike' when f1 > 0 and f3 / f1 > 1.5 then 'increasing' when f1 > 0 and f3 / f1 < 0.7 then 'declining' else 'stable' end as trend from a""",
)
def change_trend(spark, sf_dir):
    return S.trend(error_series(spark, sf_dir))


@query("log_histogram_5m", "select time_bucket(interval 5 minutes, ts) as bucket, count(*) as count from events group by 1")
def log_histogram_5m(spark, sf_dir):
    return S.histogram(logs(spark, sf_dir), "5 minutes")


@query("calendar_hours", f"with {FILLED} select bucket, count from f")
def calendar_hours(spark, sf_dir):
    return error_series(spark, sf_dir)


LOW, HIGH = datetime.datetime(2024, 1, 20, 8), datetime.datetime(2024, 1, 20, 12)


@query(
    "baseline_7d",
    "with d as (select k, (select count(*) from events where event_type = 'error' and ts >= timestamp '2024-01-20 08:00:00' - k * interval 1 day and ts <= timestamp '2024-01-20 12:00:00' - k * interval 1 day) as c from range(1, 8) r(k)) select coalesce(round_even(avg(c) filter (c > 0), 0), 0)::bigint as baseline, count(*) filter (c > 0) as days from d",
)
def baseline_7d(spark, sf_dir):
    return S.daily_baseline(logs(spark, sf_dir).where("event_type = 'error'"), LOW, HIGH)


@query(
    "trend_acceleration",
    "with m as (select max(ts) as t from events), a as (select count(*) filter (ts >= t - interval 30 minutes and ts < t) as recent, count(*) filter (ts >= t - interval 180 minutes and ts < t - interval 30 minutes) / 6.0::double as baseline from events, m), r as (select *, case when baseline < 5 then 0.0::double else recent / baseline end as ratio from a) select *, case when ratio >= 6 then 'critical' when ratio >= 3 then 'warning' else 'none' end as severity from r",
)
def trend_acceleration(spark, sf_dir):
    rows = logs(spark, sf_dir)
    return S.acceleration(rows, F.lit(rows.agg(F.max("ts")).first()[0]))


@query(
    "context_window",
    f"with {LOGS} select a.log_id, count(b.log_id) as near from logs a join logs b on b.ts between a.ts - interval 10 minutes and a.ts + interval 10 minutes and a.service = b.service where a.level = 'ERROR' and b.level in ('WARNING', 'ERROR') group by 1",
)
def context_window(spark, sf_dir):
    rows = logs(spark, sf_dir).select("log_id", "ts", "service", "level")
    marks = rows.where("level = 'ERROR'").select("log_id", "ts", "service")
    other = rows.where("level in ('WARNING', 'ERROR')").select(F.col("ts").alias("right_ts"), F.col("service").alias("other_service"))
    return S.near(marks, other, 10, F.col("service") == F.col("other_service")).groupBy("log_id").agg(F.count("*").alias("near"))


@query(
    "cross_service_errors",
    f"with {LOGS}, e as (select service, (service + k) % 8 as related, case when k = 1 then 'upstream' else 'downstream' end as direction from (select unnest(range(8)) as service) s, (select unnest([1, 2]) as k) k), j as (select e.service, e.related, e.direction, l.log_id, row_number() over (partition by e.service, e.related order by l.ts desc, l.log_id desc) as place from e join logs l on l.service = e.related and l.level = 'ERROR' and l.ts between timestamp '2024-01-20 07:55:00' and timestamp '2024-01-20 12:05:00') select service, related, direction, count(*) as errors, min(log_id) as first_id from j where place <= 10 group by 1, 2, 3",
)
def cross_service_errors(spark, sf_dir):
    """The latest 10 errors of each related service in a window widened by 5 minutes. Edges: the next two services."""
    from pyspark.sql import Window

    edges = spark.range(8).select(F.col("id").alias("service"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("service", ((F.col("service") + F.col("k")) % 8).alias("related"), F.when(F.col("k") == 1, "upstream").otherwise("downstream").alias("direction"))
    wide = (F.col("ts") >= F.lit(LOW - datetime.timedelta(minutes=5))) & (F.col("ts") <= F.lit(HIGH + datetime.timedelta(minutes=5)))
    errors = logs(spark, sf_dir).where(wide & (F.col("level") == "ERROR")).select("log_id", "ts", F.col("service").alias("related"))
    place = F.row_number().over(Window.partitionBy("service", "related").orderBy(F.desc("ts"), F.desc("log_id")))
    return errors.join(F.broadcast(edges), "related").withColumn("place", place).where("place <= 10").groupBy("service", "related", "direction").agg(F.count("*").alias("errors"), F.min("log_id").alias("first_id"))


@query(
    "rate_limit_flags",
    f"with {LOGS} select log_id, service, count(*) over (partition by service order by ts range between interval '3599.999999 seconds' preceding and current row) as in_window, count(*) over (partition by service order by ts range between interval '3599.999999 seconds' preceding and current row) > 3 as limited from logs",
)
def rate_limit_flags(spark, sf_dir):
    return S.rate_flags(logs(spark, sf_dir).select("log_id", "service", "ts"), 3, 3600, "service").drop("ts")


@query(
    "alert_first_in_window",
    f"""with recursive {LOGS}, t as (select service, floor(epoch(ts))::bigint as s, count(*) as n from logs where level = 'ERROR' group by 1, 2),
    w as (select service, min(s) as opened from t group by 1 union all select w.service, min(t.s) as opened from w join t on t.service = w.service and t.s >= w.opened + 3600 group by w.service, w.opened)
    select w.service, make_timestamp(w.opened * 1000000) as opened, sum(t.n)::bigint as alerts from w join t on t.service = w.service and t.s >= w.opened and t.s < w.opened + 3600 group by 1, 2""",
)
def alert_first_in_window(spark, sf_dir):
    return S.first_in_window(logs(spark, sf_dir).where("level = 'ERROR'").select("ts", "service"), 3600, "service")
