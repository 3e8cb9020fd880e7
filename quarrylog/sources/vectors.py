"""Tables of vectors with a fixed length: made once with their schema, then appended to; each append is checked and can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.sources import scratch

CHUNKS = "doc_id string, kb_id string, content string, metadata map<string, string>, chunk_index int, embedding array<float>"
ISSUES = (
    "issue_id string, business_line_id string, error_signature string, analysis_content string, severity string, task_id string, embedding array<float>, created_at timestamp_ntz, ttl_expire_at timestamp_ntz, "
    "status string, hit_count long, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved_at timestamp_ntz, feedback_quality string"
)


def create(spark: SparkSession, folder: str, schema: str = CHUNKS, dimension: int = 1536) -> bool:
    """Makes an empty table, unless it is there; whether it has made one. A table that is there with other columns or another dimension is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/layout")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if there:
        if layout(spark, folder) != (spark.createDataFrame([], schema).schema.simpleString(), dimension):
            raise ValueError(f"{folder} holds other columns or vectors of another length")
        return False
    empty = spark.createDataFrame([], schema)
    empty.write.mode("overwrite").parquet(f"{folder}/schema")
    spark.createDataFrame([(empty.schema.simpleString(), dimension)], "columns string, dimension int").coalesce(1).write.parquet(f"{folder}/layout")
    return True


def layout(spark: SparkSession, folder: str) -> tuple[str, int]:
    row = spark.read.parquet(f"{folder}/layout").first()
    return row["columns"], row["dimension"]


def checked(vector: Column, dimension: int) -> Column:
    """The vector, if it has that length and finite values; else the query fails."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = vector.isNotNull() & (F.size(vector) == dimension) & finite
    return F.when(F.coalesce(fine, F.lit(False)), vector).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dimension} finite values is needed, not one of "), F.coalesce(F.size(vector), F.lit(0)).cast("string"))).cast("array<float>"))


def append(rows: DataFrame, folder: str, batch: str) -> int:
    """Adds rows, with columns in any order and missing ones null, under a batch's name, and returns how many: the same batch again replaces itself, so a job that is repeated adds nothing twice.

    Nothing is added if a vector doesn't fit: Spark's writer puts files in place when all tasks are done.
    """
    spark = rows.sparkSession
    columns, dimension = layout(spark, folder)
    schema = spark.read.parquet(f"{folder}/schema").schema
    own = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    path = f"{folder}/data/batch={batch}"
    scratch.delete(spark, path)
    own.withColumn("embedding", checked(F.col("embedding"), dimension)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path).count()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows; none from a table without batches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    empty = spark.read.parquet(f"{folder}/schema")
    return spark.read.schema(empty.schema).parquet(f"{folder}/data") if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else empty
