"""Tables of tenants' rows with inserts, updates and deletes, as copy-on-write snapshots in Parquet.

A tenant's rows lie in buckets by a hash of their id. A change reads and writes only the buckets that hold its ids, in a folder of its own, with Spark's partitioned
writer; the new version's manifest says for each bucket which change has written it, and is put in place last, by a rename. So readers
of a version, old or new, see it whole at any time, a writer that stops leaves nothing that is read, and of two writers the later one fails. Rows of other tenants can't be
reached: their buckets are not read, whatever the ids are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.sources import scratch

BUCKETS = 64
KEY = ["tenant", "bucket", "written"]
MANIFEST = "tenant string, bucket int, written long"


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def latest(spark: SparkSession, folder: str) -> int:
    """The version that is current, -1 if there is none."""
    store, path = _path(spark, f"{folder}/manifest")
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=-1)


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{version}")


def _commit(table: DataFrame, folder: str, version: int) -> None:
    spark = table.sparkSession
    temporary = f"{folder}/manifest/_tmp-{uuid.uuid4().hex}"
    table.coalesce(1).write.parquet(temporary)
    store, source = _path(spark, temporary)
    target = _path(spark, f"{folder}/manifest/{version}")[1]
    if store.exists(target) or not store.rename(source, target):
        store.delete(source, True)
        raise RuntimeError(f"version {version} of {folder} is there already: another writer was first")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def _put(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (tenant, bucket and the table's columns), dealt by Spark to files of even size, as files of their own and returns their part of the manifest."""
    written = uuid.uuid4().int >> 66
    path = f"{folder}/data/written={written}"
    rows.write.partitionBy("tenant", "bucket").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select("tenant", "bucket", F.lit(written).alias("written")).distinct()


def create(rows: DataFrame, folder: str, tenant: str = "tenant_id", buckets: int = BUCKETS) -> int:
    """Version 0 of a table: rows (id, tenant and others). Ids are unique within a tenant."""
    spark = rows.sparkSession
    own = _bucketed(rows.withColumnRenamed(tenant, "tenant").withColumn("tenant", F.col("tenant").cast("string")), buckets)
    own.limit(0).withColumn("_buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/schema-{buckets}")
    spark.createDataFrame([(tenant, buckets)], "tenant string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    _commit(_put(own.hint("rebalance", "tenant", "bucket"), folder), folder, 0)
    return 0


def _layout(spark: SparkSession, folder: str) -> tuple[str, int]:
    row = spark.read.parquet(f"{folder}/layout").first()
    return row["tenant"], row["buckets"]


def _stored(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    _, buckets = _layout(spark, folder)
    schema = spark.read.parquet(f"{folder}/schema-{buckets}").drop("_buckets").withColumn("written", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{folder}/data").join(files, KEY)


def read(spark: SparkSession, folder: str, version: int | None = None, tenant: str | None = None) -> DataFrame:
    """The rows of a version, the current one by default; with a tenant, only its rows, of which only its files are read."""
    files = manifest(spark, folder, latest(spark, folder) if version is None else version)
    name, _ = _layout(spark, folder)
    rows = _stored(spark, folder, files if tenant is None else files.where(F.col("tenant") == tenant))
    rows = rows if tenant is None else rows.where(F.col("tenant") == tenant)
    return rows.drop("written", "bucket").withColumnRenamed("tenant", name)


def change(spark: SparkSession, folder: str, tenant: str, inserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> dict[str, int]:
    """Applies deletes (id), updates (id and the columns that change, nulls included) and inserts (all columns but the tenant) to one tenant's rows, as the next version.

    Returns version and how many rows were inserted, updated and deleted. Ids of the tenant's that aren't there change nothing. An insert of an id that stays, or of one
    twice, is refused, as are updates that name an id twice.
    """
    version = latest(spark, folder)
    name, buckets = _layout(spark, folder)
    ids = [_bucketed(d.select("id"), buckets).select("bucket") for d in (inserts, updates, deletes) if d is not None]
    touched = scratch.stash(reduce(DataFrame.union, ids).distinct(), "touched")
    files = manifest(spark, folder, version)
    own = files.where(F.col("tenant") == tenant).join(touched, "bucket", "left_semi")
    old = _stored(spark, folder, own).where(F.col("tenant") == tenant).drop("written")
    gone = scratch.stash(deletes.select("id").distinct(), "gone") if deletes is not None else None
    kept = old if gone is None else old.join(gone, "id", "left_anti")
    if updates is not None:
        if updates.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an update names an id twice")
        new = updates.drop(name).select("id", F.struct(*[c for c in updates.columns if c not in ("id", name)]).alias("_new"))
        changed = [c for c in updates.columns if c not in ("id", name)]
        kept = kept.join(new, "id", "left").withColumn("_updated", F.col("_new").isNotNull())
        kept = kept.withColumns({c: F.when(F.col("_updated"), F.col(f"_new.{c}")).otherwise(F.col(c)).cast(old.schema[c].dataType) for c in changed}).drop("_new")
    else:
        kept = kept.withColumn("_updated", F.lit(False))
    kept = kept.withColumn("_inserted", F.lit(False))
    if inserts is not None:
        rows = _bucketed(inserts.drop(name).withColumns({"tenant": F.lit(tenant), "_updated": F.lit(False), "_inserted": F.lit(True)}), buckets)
        kept = kept.unionByName(rows.select(*[F.col(c).cast(kept.schema[c].dataType).alias(c) for c in kept.columns]))
    kept = scratch.stash(kept, "changed")
    if kept.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id is inserted that is there already, or twice")
    counts = kept.agg(F.count_if("_inserted").alias("inserted"), F.count_if("_updated").alias("updated")).first()
    deleted = 0 if gone is None else old.join(gone, "id", "left_semi").count()
    news = _put(kept.drop("_updated", "_inserted").select(*old.columns).hint("rebalance", "bucket"), folder)
    rest = files.join(own.select("tenant", "bucket"), ["tenant", "bucket"], "left_anti").select(*KEY)
    _commit(rest.unionByName(news), folder, version + 1)
    return {"version": version + 1, "inserted": counts["inserted"], "updated": counts["updated"], "deleted": deleted}


def page(rows: DataFrame, offset: int, limit: int, order: str = "created_at", descending: bool = True, **filters) -> tuple[DataFrame, int, int]:
    """One page of the rows that equal the filters (None: any), in order and then by id, with the number of all of them and of pages."""
    for column, value in filters.items():
        if column in rows.columns and value is not None:
            rows = rows.where(F.col(column) == value)
    by = [F.desc(order) if descending else F.asc(order)] if order in rows.columns else []
    total = rows.count()
    return rows.orderBy(*by, "id").offset(offset).limit(limit), total, -(-total // limit) if limit else 0
