"""Log-analysis tables from the given ones: logs, tasks, results, tool calls, business lines, learned signals.

Each maps a given table's columns, row by row, so that filters and column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions import values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level_of(event_type: Column) -> Column:
    return F.when(event_type == "error", "ERROR").when(event_type == "purchase", "WARNING").when(event_type == "signup", "INFO").otherwise("DEBUG")


def message_of(event_id: Column, user_id: Column, event_type: Column) -> Column:
    """A message in the form of the event's kind: an exception with a frame, a JSON answer, or a plain line."""
    kind = F.element_at(F.array(*map(F.lit, ("IllegalStateException", "NullPointerException", "TimeoutException", "SQLException"))), (event_id % 4 + 1).cast("int"))
    failed = F.concat(F.lit("[ERROR] java.lang."), kind, F.lit(": request "), event_id, F.lit(" failed for user "), user_id, F.lit("\n  at com.app.Service"), user_id % 3, F.lit(".run(Service.java:"), event_id % 90 + 10, F.lit(")"))
    answer = F.concat(F.lit('[WARN] {"status": true, "order": '), event_id, F.lit("}"))
    plain = F.concat(F.when(event_type == "signup", "[INFO] ").otherwise("[ERROR] "), F.lit("request "), event_id, F.lit(" served in "), event_id % 300 + 1000, F.lit(" ms"))
    return F.when(event_type == "error", failed).when(event_type == "purchase", answer).otherwise(plain)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, ts, level, service, user_id, message, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("log_id"), "ts", level_of(F.col("event_type")).alias("level"), (F.col("user_id") % 8).alias("service"), "user_id", "event_type", message_of(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("message"), "value")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, line_id, status, task_type, tokens, error_message, created_at, minutes."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    skipped = F.when(key % 15 == 0, f"skipped: {V.QUALITY_SKIP}").when(key % 10 == 0, f"skipped: {V.FINGERPRINT_SKIP}")
    tokens = F.when(key % 5 == 0, F.lit(0)).otherwise(F.floor("o_totalprice")).cast("long")
    kind = F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2"), "alert_triggered").when(F.col("o_orderpriority").startswith("3"), "manual").otherwise("scheduled")
    return o.select(key.alias("task_id"), (F.col("o_custkey") % 20).alias("line_id"), status.alias("status"), kind.alias("task_type"), tokens.alias("tokens"), skipped.alias("error_message"), F.col("o_orderdate").alias("created_at"), (key % 7 + 1).alias("minutes"), F.round(F.col("o_totalprice") / 100).cast("long").alias("log_count"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, task_id, severity, confidence, feedback, content."""
    i = table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    feedback = F.when(F.col("l_linenumber") % 3 == 1, 1).when(F.col("l_linenumber") % 3 == 2, -1)
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"), F.col("l_orderkey").alias("task_id"), severity.alias("severity"), (F.col("l_discount") * 10).alias("confidence"), feedback.alias("feedback"), F.concat(F.lit("pattern "), F.col("l_partkey") % 50).alias("content"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, step, tool, result_length, duration_ms, success."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("step"), F.col("role").alias("tool"), n.alias("result_length"), (n * 3).alias("duration_ms"), (n % 7 != 0).alias("success"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, name, weight, core: the business lines, from nations."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("line_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 10 + 1).alias("weight"), (F.col("n_regionkey") == 1).alias("core"))


def index_listing(listing: DataFrame, prefix: str = "") -> DataFrame:
    """A catalog listing (name, ...) without hidden names, but with data streams."""
    return listing.where((~F.col("name").startswith(".") | F.col("name").startswith(".ds-")) & F.col("name").startswith(prefix))


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table: chunks, results, issues and vectors alike."""
    df.write.mode("append").parquet(path)


def scoped(df: DataFrame, tenant_id) -> DataFrame:
    """Only one tenant's rows."""
    return df.where(F.col("tenant_id") == tenant_id)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page number, from 1, of so many rows in an order that must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
