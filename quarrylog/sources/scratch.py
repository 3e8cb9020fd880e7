"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary folder on a local master and the warehouse on a cluster."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        spark.conf.set("spark.checkpoint.dir", base := "file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
        return base
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone by then
            return

    atexit.register(drop)
    return path


def add(df: DataFrame, path: str) -> None:
    """Adds df's rows to the table at a path."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that later steps neither repeat nor depend on what made it."""
    path = scratch(df.sparkSession, name)
    add(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
