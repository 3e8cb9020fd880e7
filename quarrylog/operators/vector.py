"""Nearest vectors: top k of a library by cosine for each query, with filters before any distance is taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.sources import scratch

#: Queries that are sent to the tasks at once, and the numbers of queries and vectors whose products are made at once.
MOST_QUERIES = 4096
TILE = 512


def unit(v: Column) -> Column:
    """The vector in double precision, divided by its length."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.try_divide(x, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def best(scored: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score -> the k best of each query with their place; each task keeps k for a query before the shuffle by Spark's group limit under the rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.select("query_id", "vec_id", F.round("score", 6).alias("score"), place.alias("place")).where(F.col("place") <= k)


def in_blocks(queries: DataFrame, score, k: int) -> DataFrame:
    """The best k by score (queries -> query_id, vec_id, score), for more than MOST_QUERIES queries block by block.

    The blocks, three quarters of that on average, are split by a hash of query_id, which must be unique, and asked one after another; what a block finds is
    added to one table in the shared folder. A query is in one block only, so the rows together are the result.
    """
    n = queries.count()
    if n <= MOST_QUERIES:
        return best(score(queries), k)
    blocks = -(-4 * n // (3 * MOST_QUERIES))
    queries = scratch.stash(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    path = scratch.scratch(queries.sparkSession, "nearest")
    for i in range(blocks):
        found = best(score(queries.where(F.col("block") == i).drop("block")), k)
        scratch.add(found, path)
    return queries.sparkSession.read.schema(found.schema).parquet(path)


def knn(queries: DataFrame, library: DataFrame, k: int, least: float = -1.0, on: Column | None = None) -> DataFrame:
    """queries (query_id, q) and library (vec_id, v) -> query_id, vec_id, score, place: exact, ties by vec_id; on: any condition of both sides.

    A block of queries is broadcast, so the library is read once for each block and isn't moved. Vectors that are null, zero or of another length are near to none.
    """

    def score(asked: DataFrame) -> DataFrame:
        scored = library.withColumn("u", unit(F.col("v"))).join(F.broadcast(asked.withColumn("uq", unit(F.col("q")))), on if on is not None else F.lit(True))
        return scored.withColumn("score", dot(F.col("u"), F.col("uq"))).where(F.col("score") >= least)

    return in_blocks(queries, score, k)


def units(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lists have that length, finite values and a norm above zero, and these as rows of length one in double precision."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), length), False).to_numpy(zero_copy_only=False))
    rows = lists.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(all="ignore"):
        norm = np.sqrt((rows * rows).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        return fits[fine], rows[fine] / norm[fine, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of a and of b, summed in one order whatever the places of the rows, so that equal vectors tie."""
    out, at_once = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, np.ascontiguousarray(b.T), strict=True):
        out += np.multiply(x[:, None], y, out=at_once)
    return out


class Best:
    """The k nearest so far of queries of one length and label; vectors must come by rising id, as of a tie the first stays."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, apart: bool):
        self.ids, self.rows, self.apart = ids, rows, apart
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for i in range(0, len(self.ids), TILE):
            for j in range(0, len(ids), TILE):
                self.see_tile(slice(i, i + TILE), ids[j : j + TILE], rows[j : j + TILE])

    def see_tile(self, part: slice, ids: np.ndarray, rows: np.ndarray) -> None:
        new = products(self.rows[part], rows)
        if self.apart:
            new[self.ids[part][:, None] == ids] = -np.inf
        better = np.flatnonzero(new.max(axis=1) > self.scores[part][:, -1])
        k, at = self.scores.shape[1], better + part.start
        scores = np.concatenate([self.scores[at], new[better]], axis=1)
        found = np.concatenate([self.found[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        for place in range(k):
            first = scores.argmax(axis=1)[:, None]
            self.scores[at, place] = np.take_along_axis(scores, first, 1)[:, 0]
            self.found[at, place] = np.take_along_axis(found, first, 1)[:, 0]
            np.put_along_axis(scores, first, -np.inf, 1)


def knn_by_tiles(queries: DataFrame, library: DataFrame, k: int, least: float = -1.0, same: str | None = None, apart: bool = False) -> DataFrame:
    """knn of whole tiles of vectors at a time: the same rows in far less time, for the usual conditions.

    same: a column of both sides that must be equal and not null; apart: not the vector whose id is the query's. Ids are longs. Vectors that are null, zero, of
    another length, hold null or non-finite values, or have no id are near to none. A block of queries goes to the tasks with the function; each task reads its
    vectors by rising id and gives k rows for a query, so the shuffle doesn't grow with the pairs.
    """
    others = [] if same is None else [same]

    def score(asked: DataFrame) -> DataFrame:
        block = asked.where("query_id is not null").select(F.col("query_id").cast("long"), "q", *others).toArrow().combine_chunks()
        groups = []
        for label in [None] if same is None else pc.drop_null(pc.unique(block[same])).to_pylist():
            of = block if same is None else block.filter(pc.equal(block[same], label))
            q, ids = of["q"].combine_chunks(), of["query_id"].to_numpy()
            for length in pc.unique(pc.drop_null(pc.list_value_length(q))).to_pylist():
                at, rows = units(q, length)
                groups.append((label, length, ids[at], rows))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = [(label, length, Best(ids, rows, k, apart)) for label, length, ids, rows in groups]
            for batch in batches:
                for label, length, own in nearest:
                    of = batch if label is None else batch.filter(pc.equal(batch.column(same), label))
                    at, rows = units(of.column("v"), length)
                    own.see(of.column("vec_id").to_numpy()[at], rows)
            for _, _, own in nearest:
                query, place = np.nonzero(own.scores >= least)
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[query]), pa.array(own.found[query, place]), pa.array(own.scores[query, place])], ["query_id", "vec_id", "score"])

        rows = library.where("vec_id is not null").select(F.col("vec_id").cast("long"), "v", *others).sortWithinPartitions("vec_id")
        return rows.mapInArrow(scan, "query_id long, vec_id long, score double")

    return in_blocks(queries, score, k)
