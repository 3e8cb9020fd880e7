"""Time series of log counts: histograms, calendar fill, change points, trends, baselines, context and service windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(logs: DataFrame, width: str, *keys: str) -> DataFrame:
    """Rows in each window of so long, by keys, as bucket and count."""
    spot = F.window(F.col("ts").cast("timestamp_ntz"), width)["start"]
    return logs.groupBy(*keys, spot.cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("count"))


def fill(series: DataFrame, width: str, low=None, high=None) -> DataFrame:
    """series (bucket, count) with a row of 0 for each bucket of the calendar that it lacks, from low to high, else its own ends."""
    ends = series.agg(F.coalesce(F.lit(low).cast("timestamp_ntz"), F.min("bucket")).alias("low"), F.coalesce(F.lit(high).cast("timestamp_ntz"), F.max("bucket")).alias("high")).where("low is not null")
    calendar = ends.select(F.explode(F.sequence("low", "high", F.expr(f"interval {width}"))).alias("bucket"))
    return calendar.join(series, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def change_points(series: DataFrame, threshold: float = 3.0, lookback: int = 30, ahead: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Buckets whose count lies threshold deviations or more above the mean of the lookback buckets before; a deviation is 0.5 at least.

    Variances come from sums of integers, so they are exact. The frame is per key; without keys there are as many rows as the
    calendar has buckets.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    past = order.rowsBetween(-lookback, -1)
    n, s, s2 = F.count("*").over(past), F.sum("count").over(past), F.sum(F.col("count") * F.col("count")).over(past)
    seen = series.withColumns({"n": n, "s": s, "s2": s2, "after_rate": F.avg("count").over(order.rowsBetween(0, ahead - 1))}).where(F.col("n") == lookback)
    mean = F.col("s") / lookback
    deviation = F.greatest(F.sqrt((F.col("s2") * lookback - F.col("s") * F.col("s")) / (lookback * lookback)), F.lit(0.5))
    out = seen.withColumns({"before_rate": mean, "z": (F.col("count") - mean) / deviation}).where(F.col("z") >= threshold)
    return out.select(*keys, "bucket", "count", F.round("z", 4).alias("z"), F.round("before_rate", 4).alias("before_rate"), F.round("after_rate", 4).alias("after_rate"))


def trend(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """unknown (under 6 buckets), spike, increasing, declining or stable, from the means of the first and last third and the peak."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    every = Window.partitionBy(*keys)
    rows = series.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(every)}).withColumn("third", F.floor(F.col("n") / 3))
    first, last = F.avg(F.when(F.col("i") <= F.col("third"), F.col("count"))), F.avg(F.when(F.col("i") > F.col("n") - F.col("third"), F.col("count")))
    sums = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.max("count").alias("peak"), first.alias("first_third"), last.alias("last_third"))
    f, ratio = F.col("first_third"), F.col("last_third") / F.nullif(F.col("first_third"), F.lit(0.0))
    kind = F.when(F.col("n") < 6, "unknown").when(((f > 0) & (F.col("peak") > 5 * f)) | ((f == 0) & (F.col("peak") > 10)), "spike").when(ratio > 1.5, "increasing").when(ratio < 0.7, "declining").otherwise("stable")
    return sums.select(*keys, "n", "peak", kind.alias("trend"))


def acceleration(logs: DataFrame, as_of: Column, hours: int = 3, minutes: int = 30) -> DataFrame:
    """The latest minutes against the mean of the windows before, of which one fewer is counted than divided by; ratio 0 if that mean is under 5."""
    back = lambda m: as_of - F.make_dt_interval(mins=F.lit(m))
    recent = F.count_if((F.col("ts") >= back(minutes)) & (F.col("ts") < as_of))
    before = F.count_if((F.col("ts") >= back(hours * 60)) & (F.col("ts") < back(minutes)))
    sums = logs.agg(recent.alias("recent"), (before / (hours * 60 / minutes)).alias("baseline"))
    ratio = F.when(F.col("baseline") < 5, 0.0).otherwise(F.col("recent") / F.col("baseline"))
    return sums.withColumn("ratio", ratio).withColumn("severity", F.when(F.col("ratio") >= 6, "critical").when(F.col("ratio") >= 3, "warning").otherwise("none"))


def daily_baseline(logs: DataFrame, low, high, days: int = 7) -> DataFrame:
    """Rows in the same window of each of the days before, by day; baseline is the rounded mean of the days that have some.

    One pass: a row's day is how many whole days it lies before the window, so there is no join with the days.
    """
    span = F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))
    behind = F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.floor(behind / 86_400_000_000)
    inside = (behind - day * 86_400_000_000 <= span) & (day >= 1) & (day <= days)
    counts = logs.where((F.col("ts") <= F.lit(high)) & (F.col("ts") >= F.lit(low) - F.make_dt_interval(days=F.lit(days)))).where(inside).groupBy(day.alias("day")).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.bround(F.avg(F.when(F.col("c") > 0, F.col("c")))), F.lit(0.0)).cast("long").alias("baseline"), F.count("*").alias("days"))


def near(left: DataFrame, right: DataFrame, minutes: int, on: Column | None = None) -> DataFrame:
    """left (ts) joined with right (right_ts) where right_ts lies within minutes of ts.

    Each left row looks into the three buckets of that width that can hold partners, so it is an equi-join on the bucket, not a nested loop.
    """
    width = minutes * 60_000_000
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    spread = left.withColumn("_b", F.explode(F.array(at("ts") - 1, at("ts"), at("ts") + 1)))
    other = right.withColumn("_rb", at("right_ts"))
    apart = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("right_ts").cast("timestamp"))) <= width
    joined = spread.join(other, (F.col("_b") == F.col("_rb")) & apart & (on if on is not None else F.lit(True)))
    return joined.drop("_b", "_rb")


def rate_flags(requests: DataFrame, limit: int, seconds: int, *keys: str) -> DataFrame:
    """Each request with the number in its key's last seconds, itself included, and whether it is over the limit. Rejected requests count as well."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    sliding = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count("*").over(sliding)).withColumn("limited", F.col("in_window") > limit)


def first_in_window(alerts: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Each window with its number of alerts: it opens at the first alert outside the one before and isn't prolonged.

    What opens a window depends on where the last one opened, so times are walked through in order. They are counted per second
    first, and cut where a gap as long as a window lies before an alert, as that alert opens a window whatever came earlier: a task
    walks one stretch without such a gap, from window to window.
    """
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    times = alerts.withColumn("second", second).groupBy(*keys, "second").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("second")
    cut = F.coalesce(F.col("second") - F.lag("second").over(order) >= seconds, F.lit(True)).cast("int")
    stretches = times.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(order)).drop("cut")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("second")
        at, sums = pdf["second"].to_numpy(), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        rows, i = [], 0
        while i < len(at):
            end = int(np.searchsorted(at, at[i] + seconds))
            rows.append((at[i], sums[end] - sums[i]))
            i = end
        out = pd.DataFrame(rows, columns=["opened", "alerts"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "opened", "alerts"]]

    kinds = "".join(f"{k} {alerts.schema[k].dataType.simpleString()}, " for k in keys)
    found = stretches.groupBy(*keys, "stretch").applyInPandas(walk, f"{kinds}opened long, alerts long")
    return found.withColumn("opened", F.timestamp_seconds("opened").cast("timestamp_ntz"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
