"""What an investigating agent asks of the logs, as functions of DataFrames: search, context, patterns, comparison, similar incidents, other services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V
from quarrylog.operators import search, timeseries, vector


def search_logs(logs: DataFrame, query: str, low, high, size: int = 50) -> DataFrame:
    """The newest matches, their messages cut to 500 characters."""
    where = search.between(F.col("ts"), low, high) & search.text_filter(query, F.col("message"))
    return search.search(logs, where, min(size, 50)).withColumn("message", F.substring("message", 1, 500))


def log_context(logs: DataFrame, at, minutes: int = 5, least: str = "WARNING", size: int = 50) -> DataFrame:
    """Logs of that level or above around a time, in order."""
    spread = F.make_dt_interval(mins=F.lit(minutes))
    where = (F.col("ts") >= F.lit(at) - spread) & (F.col("ts") <= F.lit(at) + spread) & (X.lookup(F.upper("level"), V.LEVEL_RANK, 0) >= V.LEVEL_RANK[least])
    return logs.where(where).orderBy("ts", "log_id").limit(size)


def count_error_patterns(logs: DataFrame, by: str, most: int = 50) -> DataFrame:
    """Errors by their pattern, by service or by 5-minute bucket, the most frequent first, or for buckets the first in time."""
    errors = logs.where("level = 'ERROR'")
    if by == "time":
        return timeseries.histogram(errors, "5 minutes").orderBy("bucket").limit(most)
    key = X.group_key(F.col("message")) if by == "pattern" else F.col(by)
    return search.terms(errors, key, most)


def similar_incidents(issue: DataFrame, library: DataFrame, k: int = 3) -> DataFrame:
    """issue (query_id, q) against all of the library (vec_id, v), whatever its line or quality."""
    return vector.knn_by_tiles(issue, library, k)


def known_issue(issues: DataFrame, issue_id) -> DataFrame:
    """One issue without its vector."""
    return issues.where(F.col("id") == issue_id).drop("embedding")


def compare_with_baseline(logs: DataFrame, low, high, days: int = 7) -> DataFrame:
    """Errors in a window, those usual at that time of day, and the ratio."""
    errors = logs.where("level = 'ERROR'")
    now = errors.where(search.between(F.col("ts"), low, high)).agg(F.count("*").alias("current"))
    usual = timeseries.daily_baseline(errors, low, high, days)
    return now.join(F.broadcast(usual)).withColumn("ratio", F.round(F.col("current") / F.greatest("baseline", F.lit(1)), 4))


def other_services(logs: DataFrame, own, low, high, query: str | None = None, most: int = 5) -> DataFrame:
    """The services, but the own one, with most errors in a window that hold a text."""
    where = search.between(F.col("ts"), low, high) & (F.col("service") != own) & (F.col("level") == "ERROR")
    rows = logs.where(where if query is None else where & search.text_filter(query, F.col("message")))
    return search.terms(rows, F.col("service"), most)


def related(upstream, downstream, most: int = 6):
    """Arrays of services above and below -> the first of both in order, with their direction; one that is in both is upstream."""
    direction = lambda s: F.when(F.array_contains(upstream, s), "upstream").otherwise("downstream")
    return F.transform(F.slice(F.concat(upstream, downstream), 1, most), lambda s: F.struct(s.alias("service"), direction(s).alias("direction")))


def other_indices(catalog: DataFrame, patterns: DataFrame, service: str | None = None, most: int = 5, hidden: tuple[str, ...] = (".",)) -> DataFrame:
    """catalog (name) and a line's own patterns (pattern, with stars) -> name, in order: the first indices of other lines whose names hold a text, without hidden ones.

    A name is excluded if it starts with a pattern's text without stars. Each name is looked up by all its prefixes, so that the exclusion is an equi-join,
    not a comparison of each name with each pattern.
    """
    bases = patterns.select(F.explode(F.split("pattern", ",")).alias("p")).select(F.replace(F.trim("p"), F.lit("*"), F.lit("")).alias("prefix")).where("prefix <> ''").distinct()
    shown = catalog.select("name").distinct()
    for mark in hidden:
        shown = shown.where(~F.col("name").startswith(mark))
    if service is not None:
        shown = shown.where(F.lower("name").contains(service.lower()))
    starts = shown.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda n: F.left("name", n))).alias("prefix"))
    own = starts.join(bases, "prefix").select("name").distinct()
    return shown.where("name <> ''").join(own, "name", "left_anti").orderBy("name").limit(most)


def related_errors(edges: DataFrame, errors: DataFrame, low, high, within: Column | None = None, minutes: int = 5, most: int = 10, samples: int = 5, chars: int = 300) -> DataFrame:
    """edges (line_id, related, direction: few for a line) and errors (log_id, ts, line, message) -> for each edge with errors in the window, widened on both sides: the latest errors counted, most at most,
    and the messages of the latest samples. Errors are cut to the latest of each line before they meet the edges."""
    spread = F.make_dt_interval(mins=F.lit(minutes))
    inside = (F.col("ts") >= F.lit(low) - spread) & (F.col("ts") <= F.lit(high) + spread)
    place = F.row_number().over(Window.partitionBy("line").orderBy(F.desc("ts"), F.desc("log_id")))
    latest = errors.where(inside if within is None else inside & within).withColumn("place", place).where(F.col("place") <= most)
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", F.substring("message", 1, chars).alias("m"))))), lambda s: s["m"])
    by_line = latest.groupBy(F.col("line").alias("related")).agg(F.count("*").alias("errors"), shown.alias("samples"))
    return edges.join(by_line, "related").select("line_id", "related", "direction", "errors", "samples")
