"""Resharding by minimum-cost flow: from the shards' sizes and new capacities, the transfers that move the fewest bytes; then only files that they touch are rewritten.

A corpus lies in a folder as data/generation=G/shard=S/file=F and a manifest of each generation: which blocks of rows its files hold. A
block is a bounded part of a shard, a BLOCKS-th of an even shard's bytes or less: the texts under a hash, or a part of the rows of a text
that alone has more bytes than that (equal texts stay together but for such parts). So a shard has some BLOCKS blocks whatever the corpus, and
what is planned, and broadcast, is bounded by the numbers of shards and blocks. Files hold the large blocks first, and a block of more than
FILE_BYTES takes several. Shards give from their end, where the blocks are smallest, so that sizes come out near the capacities and
few files are touched. Rows are written under a new generation, and its manifest is put in place last, by a rename: until then the old generation
is the corpus, and its files stay for its readers until they are removed by vacuum.

Nulls, ties, empty inputs: a null text has size 1 as an empty one and is a text of its own; rows that repeat are further rows; equal blocks are ordered by number;
an empty table gives an empty corpus. All columns, whatever their names, lie in one struct row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylog.llm.shared import delete, scratch, small, stash
from quarrylog.llm.warc import file_system

BLOCKS, FILES, FILE_BYTES = 256, 16, 128 << 20
MANIFEST = "generation int, shard int, file int, block long, bytes long, n long"


def min_cost_flow(supplies: list[int], capacities: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Amounts [from, to] that send all supplies within the capacities at the least cost, by shortest augmenting paths; cost: of a unit, 1 but 0 on the diagonal.

    For numbers of shards: its arrays have a value for each pair of an old and a new one.
    """
    supply, room = np.array(supplies, np.int64), np.array(capacities, np.int64)
    if supply.sum() > room.sum():
        raise ValueError(f"capacities hold {room.sum()} of {supply.sum()} bytes")
    n, m = len(supply), len(room)
    cost = (np.arange(n)[:, None] != np.arange(m)).astype(float) if cost is None else np.asarray(cost, float)
    flow = np.zeros((n, m), np.int64)
    while supply.any():
        far, via, to, by = np.where(supply > 0, 0.0, np.inf), np.full(n, -1), np.full(m, np.inf), np.full(m, -1)
        while True:
            through = far[:, None] + cost
            nearer = through.min(0) < to - 1e-9  # ties keep the first way, so that ways have no cycle
            to, by = np.where(nearer, through.min(0), to), np.where(nearer, through.argmin(0), by)
            back = np.where(flow > 0, to - cost, np.inf)  # bytes sent to a shard may be taken back from it
            better = back.min(1) < far - 1e-9
            if not better.any():
                break
            far, via = np.where(better, back.min(1), far), np.where(better, back.argmin(1), via)
        j = int(np.where(room > 0, to, np.inf).argmin())
        path, i = [(int(by[j]), j, 1)], int(by[j])
        while via[i] >= 0:
            path.append((i, int(via[i]), -1))
            path.append((int(by[via[i]]), int(via[i]), 1))
            i = int(by[via[i]])
        amount = min([int(supply[i]), int(room[j]), *(int(flow[x, y]) for x, y, sign in path if sign < 0)])
        for x, y, sign in path:
            flow[x, y] += sign * amount
        supply[i] -= amount
        room[j] -= amount
    return flow


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def manifest(spark: SparkSession, folder: str, generation: int) -> DataFrame:
    """The blocks of a generation: where they lie, their bytes and rows."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{generation}")


def commit(table: DataFrame, folder: str, generation: int) -> None:
    spark = table.sparkSession
    temporary = f"{folder}/manifest/_tmp-{uuid.uuid4().hex}"
    table.coalesce(1).write.parquet(temporary)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(temporary).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    final = path(f"{folder}/manifest/{generation}")
    if store.exists(final) or not store.rename(path(temporary), final):
        raise RuntimeError(f"generation {generation} of {folder} is there already")


def put(rows: DataFrame, folder: str, generation: int, total: int) -> DataFrame:
    """Writes rows (shard, file, block, size, order, row), each file in one task, and returns their part of the manifest."""
    spark, path = rows.sparkSession, f"{folder}/data/generation={generation}"
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("shard", "file")})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    place = F.row_number().over(Window.partitionBy("shard", "file").orderBy("block", "order")) - 1
    dealt = rows.repartition(tasks, "shard", "file").withColumn("place", place).select("shard", "file", "block", "size", "place", "row")
    delete(spark, path)  # what a run that stopped has left
    dealt.write.partitionBy("shard", "file").option("compression", "zstd").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    return stash(written.groupBy("shard", "file", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(F.lit(generation).alias("generation"), "shard", "file", "block", "bytes", "n"), "reshard-manifest")


def lay_out(docs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes docs (text and others) as generation 0 of a corpus of so many shards by a hash of the text, and returns its manifest."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.xxhash64("text").alias("hash"), size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = stash(rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "reshard-texts")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    block_bytes, file_bytes = max(1, total // (shards * BLOCKS)), max(1, min(FILE_BYTES, total // (shards * FILES)))
    # texts with more bytes than a block: no more of them, and of their parts, than shards * BLOCKS and that again
    large = texts.where(F.col("bytes") > block_bytes).withColumn("parts", F.least("n", F.ceil(F.col("bytes") / block_bytes)))
    large = stash(large.withColumn("first", BLOCKS + F.sum("parts").over(Window.orderBy("hash")) - F.col("parts")), "reshard-large")
    shard = lambda h: F.pmod(h, F.lit(shards)).cast("int")
    usual = texts.where(F.col("bytes") <= block_bytes).select(shard(F.col("hash")).alias("shard"), F.pmod(F.xxhash64("hash"), F.lit(BLOCKS)).alias("own"), "bytes")
    parts = large.select(shard(F.col("hash")).alias("shard"), F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("own"), (F.col("bytes") / F.col("parts")).alias("bytes"))
    blocks = usual.unionByName(parts).groupBy("shard", "own").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "own")) - F.col("bytes")
    blocks = blocks.select("shard", "own", F.floor(before / file_bytes).cast("int").alias("file"), F.greatest(F.lit(1), F.ceil(F.col("bytes") / file_bytes)).alias("files"))
    blocks = stash(blocks, "reshard-blocks")
    dealt = rows.withColumn("order", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(large.select("hash", "first", "parts")), "hash", "left")
    own = F.coalesce(F.col("first") + F.pmod("order", "parts"), F.pmod(F.xxhash64("hash"), F.lit(BLOCKS)))
    dealt = dealt.select(shard(F.col("hash")).alias("shard"), own.alias("own"), "size", "order", "row").join(F.broadcast(blocks), ["shard", "own"])
    file = F.col("file") + F.pmod(F.shiftright("order", 20), F.col("files")).cast("int")
    rows.limit(0).select(*(F.lit(0).alias(c) for c in ("generation", "shard", "file")), F.lit(0).cast("long").alias("block"), "size", F.lit(0).alias("place"), "row").write.parquet(f"{folder}/schema")
    table = put(dealt.select("shard", file.alias("file"), (F.col("shard").cast("long") * (1 << 40) + F.col("own")).alias("block"), "size", "order", "row"), folder, 0, total)
    commit(table, folder, 0)
    return manifest(rows.sparkSession, folder, 0)


def transfers(old: DataFrame, capacities: list[int], cost: np.ndarray | None = None) -> DataFrame:
    """old: a manifest. shard, to, low, high: the bytes of each shard, from low to high, that go to a shard (or stay: first of all), at least cost."""
    sizes = {r["shard"]: r["bytes"] for r in old.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each shard
    shards = max(sizes, default=-1) + 1
    flow = min_cost_flow([sizes.get(i, 0) for i in range(shards)], capacities, cost)
    rows = []
    for i, amounts in enumerate(flow.tolist()):
        at = 0
        for j in sorted(range(len(amounts)), key=lambda j: (j != i, j)):
            if amounts[j]:
                rows.append((i, j, at, at + amounts[j]))
                at += amounts[j]
    return old.sparkSession.createDataFrame(rows, "shard int, to int, low long, high long")


def reshard(spark: SparkSession, folder: str, generation: int, capacities: list[int], cost: np.ndarray | None = None) -> DataFrame:
    """Moves blocks so that shard j has some capacities[j] bytes, writes what that touches as the next generation, and returns its manifest."""
    old = manifest(spark, folder, generation)
    plan = transfers(old, capacities, cost)
    blocks = old.groupBy("shard", "block").agg(F.sum("bytes").alias("bytes"))
    middle = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "block")) - F.col("bytes") / 2
    moves = blocks.withColumn("middle", middle).join(F.broadcast(plan), "shard").where("middle >= low and middle < high").select("shard", "block", "to")
    moves = stash(moves, "reshard-moves")
    found = old.join(moves, ["shard", "block"])
    touched = found.groupBy("generation", "shard", "file").agg(F.max(F.col("to") != F.col("shard")).alias("moved")).where("moved").drop("moved")
    number = F.row_number().over(Window.partitionBy("to").orderBy("shard", "generation", "file")) - 1
    news = found.join(touched, ["generation", "shard", "file"], "left_semi")
    files = stash(news.groupBy("generation", "shard", "file", "to").agg(F.sum("bytes").alias("bytes")).withColumn("new_file", number), "reshard-files")
    total = files.agg(F.sum("bytes")).first()[0] or 0
    rows = stored(spark, folder, touched)
    rows = rows.join(F.broadcast(moves), ["shard", "block"]).join(small(files.drop("bytes"), 100_000), ["generation", "shard", "file", "to"])
    rows = rows.select(F.col("to").alias("shard"), F.col("new_file").alias("file"), "block", "size", F.col("place").alias("order"), "row")
    table = old.join(touched, ["generation", "shard", "file"], "left_anti").select(*old.columns)
    if total:
        table = table.unionByName(put(rows, folder, generation + 1, total))
    commit(table, folder, generation + 1)
    return manifest(spark, folder, generation + 1)


def stored(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """generation, shard, file, block, size, place, row of all rows in these files (generation, shard, file)."""
    data = spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/data")
    return data.join(small(files.distinct(), 100_000), ["generation", "shard", "file"])


def read(spark: SparkSession, folder: str, generation: int) -> DataFrame:
    """shard, slot, size, row: the corpus of a generation; the slots of a shard are 0, 1, 2 ... file by file."""
    files = manifest(spark, folder, generation).groupBy("generation", "shard", "file").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("generation", "file")) - F.col("n")
    files = stash(files.withColumn("before", before).drop("n"), "reshard-offsets")
    return stored(spark, folder, files).select("shard", (F.col("before") + F.col("place")).alias("slot"), "size", "row")


def vacuum(spark: SparkSession, folder: str, generation: int) -> None:
    """Removes the files and manifests that only generations before this one need, the files in tasks."""
    kept = manifest(spark, folder, generation).select("generation", "shard", "file")
    olds = [f"{folder}/manifest/{g}" for g in range(generation)]
    gone = spark.read.schema(MANIFEST).parquet(*olds).select("generation", "shard", "file").distinct().join(kept, ["generation", "shard", "file"], "left_anti")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = file_system(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = f"{top}/data/generation={row.generation}/shard={row.shard}/file={row.file}"
                if store.get_file_info(path).type.name == "Directory":  # else a first attempt of this task has removed it
                    store.delete_dir(path)
            yield batch[["file"]]

    gone.mapInPandas(remove, "file int").write.mode("overwrite").format("noop").save()
    for old in olds:
        delete(spark, old)


def op12_resharding(spark, sf_dir: str, old_shards: int = 12, shards: int = 16) -> DataFrame:
    """The corpus, laid out in twelve shards, grows to sixteen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "shards")
    total = lay_out(docs, folder, old_shards).agg(F.sum("bytes")).first()[0] or 0
    reshard(spark, folder, 0, even(total, shards))
    crc: Column = F.crc32(F.coalesce(F.encode("row.text", "UTF-8"), F.lit(b"")))
    return read(spark, folder, 1).select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
