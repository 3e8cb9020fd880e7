"""Adaptive sampling of a task's logs by severity and diversity.

Slots are dealt to severities by windows over their sizes, a row for each. Rows are taken from groups in turns, one of each group, the newest first; a turn is a
row's place in its group, and each round that adds something takes a slot at least, so the newest budget rows of a group suffice and no task sorts more for a
key than Spark's group limit lets through. Of messages that repeat the first in order counts; what is left is ranked by turn and its group's newest row.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V

LEAST, MOST, DEFAULT = 20, 300, 150


def clamp_budget(budget: int) -> int:
    return min(max(budget, LEAST), MOST)


def adaptive_budget(n: Column, groups: Column, taken: Column, default: int = DEFAULT) -> Column:
    """The next budget from the last profile: more where groups were many for what was taken, less where few."""
    r = F.when(taken == 0, 0.5).otherwise(groups / taken)
    scale = F.when(r > 0.5, F.least(F.lit(1.5), 1 + r - 0.5)).when(r < 0.1, F.greatest(F.lit(0.6), 0.6 + 4 * r)).otherwise(1.0)
    adapted = F.least(F.greatest(F.floor(F.lit(default) * scale), F.lit(LEAST)), F.lit(MOST))
    return F.when(n <= default, n).when(groups.isNull() | taken.isNull(), default).otherwise(adapted)


def slots(sizes: DataFrame, budget: int, *keys: str) -> DataFrame:
    """sizes (keys, severity, n) with slots: all if a task has no more than the budget; else least numbers, then shares by weight * log2(unfilled + 1), the rest where weight * n is largest."""
    table = lambda values: F.create_map(*map(F.lit, chain(*values.items())))
    task = Window.partitionBy(*keys)
    largest_first = task.orderBy(F.desc(F.col("weight") * F.col("n")), "severity").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumns({"least": F.least("n", F.coalesce(F.try_element_at(table(V.SAMPLE_LEAST), F.col("severity")), F.lit(0))), "weight": F.coalesce(F.try_element_at(table(V.SAMPLE_WEIGHT), F.col("severity")), F.lit(1.0))})
    rows = rows.withColumns({"left": budget - F.sum("least").over(task), "score": F.col("weight") * F.log2(F.col("n") - F.col("least") + 1), "all": F.sum("n").over(task)})
    share = F.floor(F.col("left") * (F.col("score") / F.nullif(F.sum("score").over(task), F.lit(0.0))))
    rows = rows.withColumn("some", F.col("least") + F.when(F.col("left") > 0, F.least(F.coalesce(share, F.lit(0)), F.col("n") - F.col("least"))).otherwise(0))
    rows = rows.withColumns({"rest": budget - F.sum("some").over(task), "open": F.col("n") - F.col("some")})
    rows = rows.withColumn("before", F.coalesce(F.sum("open").over(largest_first), F.lit(0)))
    more = F.greatest(F.lit(0), F.least("open", F.col("rest") - F.col("before")))
    return rows.select(*keys, "severity", "n", F.when(F.col("all") <= budget, F.col("n")).otherwise(F.col("some") + more).alias("slots"))


def extracted(document: Column, source: Column, paths: dict[str, tuple[str, str]]) -> tuple[Column, Column]:
    """(level, message) of VARIANT documents of several shapes: for each source, where these lie in its documents."""
    pick = lambda i: F.coalesce(*[F.when(source == name, F.try_variant_get(document, p[i], "string")) for name, p in paths.items()])
    return pick(0), pick(1)


def sample(logs: DataFrame, budget: int, *keys: str, level: Column | None = None, message: Column | None = None) -> DataFrame:
    """logs (keys, log_id, ts) -> keys, log_id, severity, group: budget rows of each task, all of it if it has no more. level and message are columns of the logs, or made of them."""
    budget = clamp_budget(budget)
    level, message = (F.col(name) if given is None else given for name, given in (("level", level), ("message", message)))
    rows = logs.select(*keys, "log_id", "ts", F.coalesce(F.upper(level), F.lit("UNKNOWN")).alias("severity"), message.alias("message"))
    share = slots(rows.groupBy(*keys, "severity").agg(F.count("*").alias("n")), budget, *keys)
    bucket, out = [*keys, "severity"], [*keys, "log_id", "severity", "group"]
    group = X.group_key(F.col("message")).alias("group")  # made behind the joins, so once for a row
    whole = rows.join(share.where("n <= slots").drop("n", "slots"), bucket).withColumn("group", group).select(*out)
    rows = rows.join(share.where("n > slots").drop("n"), bucket).select(*bucket, "log_id", "ts", "slots", group, F.md5(F.substring("message", 1, 500)).alias("hash"))
    newest = Window.partitionBy(*bucket, "group").orderBy(F.desc("ts"), F.desc("log_id"))
    turns = rows.withColumns({"turn": F.row_number().over(newest), "first_ts": F.first("ts").over(newest), "first_id": F.first("log_id").over(newest)}).where(F.col("turn") <= budget)
    order = F.struct("turn", (-F.unix_micros(F.col("first_ts").cast("timestamp"))).alias("t"), (-F.col("first_id")).alias("i"))
    fresh = turns.groupBy(*bucket, F.coalesce("hash", F.lit("")).alias("hash")).agg(F.min_by(F.struct("log_id", "group", "slots", order.alias("order")), order).alias("r")).select(*bucket, "r.*")
    taken = Window.partitionBy(*bucket).orderBy("order")
    ranked = fresh.withColumn("rank", F.row_number().over(taken)).where(F.col("rank") <= budget)
    # a round that adds nothing ends it: turns must follow each other without a gap
    rounds = Window.partitionBy(*bucket).orderBy(F.col("order.turn"))
    ranked = ranked.withColumn("round", F.dense_rank().over(rounds)).where((F.col("order.turn") == F.col("round")) & (F.col("rank") <= F.col("slots")))
    return whole.unionByName(ranked.select(*out))
