"""Exact nearest vectors among those that a filter leaves, without most of the products: cells around pivots, rings by distance, the triangle inequality.

Vectors have length one, so a cosine is a distance. Each vector of the library lies in the cell of its nearest pivot and there in a ring of its distance to it.
A query with radius r, about as far from a pivot as d, can find vectors in the rings from d - r to d + r only, and in no cell whose pivot is
more than 2 r farther from it than the nearest one is. The radius comes from the least score asked for or, without one, from the k-th best of the
query's own cell. Cells lie together in groups of bounded size; a query goes once to each group that it needs something of, with the list of what, and a task
multiplies the rings of a group with the queries that need them, of which it gets a bounded share. Vectors without any structure can't be pruned; then it does all products, as vector.knn_by_tiles does with less ado.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.operators import vector
from quarrylog.sources import scratch

#: Pivots at most, the width of rings, vectors and queries of a block, and what rounding may do to a distance.
PIVOTS, RING, BLOCK, ASKED, SLACK = 512, 0.1, 8192, 8192, 1e-6


def pivots_of(library: DataFrame, n: int) -> np.ndarray:
    """Some sqrt(n) vectors, PIVOTS at most, each the farthest from those before among eight times as many drawn by a hash of their ids: they only decide how much is pruned."""
    most = max(1, min(PIVOTS, math.isqrt(n)))
    drawn = library.where("v is not null").select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(8 * most).toArrow()["v"].combine_chunks()
    sizes = [len(v) for v in drawn.to_pylist()]
    length = max(set(sizes), key=sizes.count, default=0)
    rows = vector.units(drawn, length)[1] if length else np.zeros((0, 0))
    chosen, far = [], np.full(len(rows), np.inf)
    while len(chosen) < most and len(rows) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * rows @ pivots.T))


def with_cells(rows: DataFrame, vec: str, pivots: np.ndarray, reach: bool) -> DataFrame:
    """rows that have a vector of the pivots' length, with u (of length one), cell and d (distance to its pivot); reach: with the distances to all pivots."""
    length, names = pivots.shape[1], [c for c in rows.columns if c != vec]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                at, u = vector.units(part.column(len(names)), length)
                d = distances(u, pivots)
                cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
                own = part.take(pa.array(at))
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                extra = [lists(d)] if reach else []
                yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], lists(u), pa.array(cell), pa.array(d[np.arange(len(d)), cell]), *extra], [*names, "u", "cell", "d", *(["to_pivots"] if reach else [])])

    typed = {"u": F.lit(None).cast("array<double>"), "cell": F.lit(0).cast("long"), "d": F.lit(0.0)} | ({"to_pivots": F.lit(None).cast("array<double>")} if reach else {})
    return rows.select(*names, vec).mapInArrow(place, rows.select(*names).withColumns(typed).schema)


def cells_of(blocks: DataFrame, same: list[str]) -> DataFrame:
    """blocks (cell, ring, n) -> for each label one row with cells: number, first group, groups, lowest and highest ring of each, PIVOTS at most.

    A group holds some BLOCK vectors: cells one after another, or a part of one that is larger.
    """
    sums = blocks.groupBy(*same, "cell").agg(F.sum("n").alias("n"), F.min("ring").alias("low"), F.max("ring").alias("high"))
    before = F.sum("n").over(vector.Window.partitionBy(*same).orderBy("cell")) - F.col("n")
    cells = sums.withColumns({"first": F.floor(before / BLOCK), "groups": F.ceil(F.col("n") / BLOCK)})
    cells = cells.groupBy(*same).agg(F.collect_list(F.struct("cell", "first", "groups", "low", "high")).alias("cells"))
    return scratch.stash(cells, "pruned-cells")


def to_groups(asked: DataFrame, cells: DataFrame, same: list[str], own: bool) -> DataFrame:
    """asked (query_id, u, radius, to_pivots, d, cell) -> a row for each query and group of vectors that it has to see, with the cells (cell, low, high ring) it needs there; own: only the query's own cell."""
    wide = F.col("radius") + SLACK
    far = lambda c: F.element_at("to_pivots", (c["cell"] + 1).cast("int"))
    need = lambda c: F.struct(c["cell"].alias("cell"), c["first"].alias("first"), c["groups"].alias("groups"), F.greatest(c["low"], F.floor((far(c) - wide) / RING)).alias("low"), F.least(c["high"], F.floor((far(c) + wide) / RING)).alias("high"))
    near = (lambda c: c["cell"] == F.col("cell")) if own else (lambda c: far(c) <= F.col("d") + 2 * wide)
    rows = asked.join(cells, same) if same else asked.crossJoin(F.broadcast(cells))  # one row, of PIVOTS cells at most
    rows = rows.withColumn("needs", F.filter(F.transform(F.filter("cells", near), need), lambda c: c["low"] <= c["high"])).drop("cells", "to_pivots")
    ids = F.array_distinct(F.flatten(F.transform("needs", lambda c: F.sequence(c["first"], c["first"] + c["groups"] - 1))))
    here = F.filter("needs", lambda c: (c["first"] <= F.col("group")) & (F.col("group") < c["first"] + c["groups"]))
    return rows.withColumn("group", F.explode(ids)).select("query_id", "u", *same, "group", F.transform(here, lambda c: F.struct(c["cell"].alias("cell"), c["low"].alias("low"), c["high"].alias("high"))).alias("needs"))


def scored(pairs: DataFrame, stored: DataFrame, same: list[str], k: int, least: float, apart: bool) -> DataFrame:
    """The k best of each query in each group: query_id, vec_id, score. Of a group only the rings are multiplied that a query needs."""
    keys = [*same, "group"]
    sizes = pairs.groupBy(*keys).agg(F.ceil(F.count("*") / ASKED).alias("of"))
    asking = pairs.join(sizes, keys).withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("of")))
    seen = stored.join(sizes, keys).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        right = right.sort_by("vec_id")
        asked, rows = (np.stack([np.asarray(x) for x in t["u"].to_numpy()]) for t in (left, right))
        ids, own = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
        needs = left["needs"].combine_chunks()
        query = np.repeat(np.arange(len(left)), np.diff(needs.offsets.to_numpy()))
        cell, low, high = (needs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        tile = right["cell"].to_numpy() * 64 + right["ring"].to_numpy()  # distances are 2 at most, so rings are few
        found = []
        for t in np.unique(tile).tolist():
            who = query[(cell == t // 64) & (low <= t % 64) & (t % 64 <= high)]
            if len(who):
                best = vector.Best(own[who], asked[who], k, apart)
                at = np.flatnonzero(tile == t)
                best.see(ids[at], rows[at])
                i, place = np.nonzero(best.scores >= least - SLACK)
                found.append((who[i], best.found[i, place], best.scores[i, place]))
        if not found:
            return none
        who, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        taken = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < k
        return pa.table({"query_id": own[who[taken]], "vec_id": vec[taken], "score": score[taken]})

    group = [*keys, "share"]
    return asking.select("query_id", "u", "needs", *group).groupBy(*group).cogroup(seen.select("vec_id", "u", "cell", "ring", *group).groupBy(*group)).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(queries: DataFrame, library: DataFrame, k: int, least: float | None = None, same: str | None = None, apart: bool = False, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, q) and library (vec_id, v) -> (query_id, vec_id, score, place: the exact k best by cosine, ties by vec_id; and the rings that were multiplied).

    least: the least cosine; same: a column of both sides that must be equal and not null; apart: not the vector whose id is the query's; where: a condition on the library, which
    is applied before anything else. Ids are longs. Vectors that are null, zero, of another length than most, or hold null or non-finite values are near to none.
    The second result: query_id, group, cell and ring with n, the vectors in it: the sum of n is the number of products.
    """
    others = [] if same is None else [same]
    spark = queries.sparkSession
    kept = library if where is None else library.where(where)
    kept = kept.where(F.col("vec_id").isNotNull() & F.lit(True if same is None else F.col(same).isNotNull())).select(F.col("vec_id").cast("long"), "v", *others)
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double")
    pivots = pivots_of(kept, kept.count())
    if not len(pivots):
        return vector.best(empty, k), spark.createDataFrame([], "query_id long, cell long, ring long, group long, n long")
    rows = with_cells(kept, "v", pivots, False).withColumn("ring", F.floor(F.col("d") / RING))
    rows = scratch.stash(rows, "pruned-library")
    cells = cells_of(rows.groupBy(*others, "cell", "ring").agg(F.count("*").alias("n")), others)
    places = cells.select(*others, F.explode("cells").alias("c")).select(*others, "c.cell", "c.first", "c.groups")
    rows = rows.join(places, [*others, "cell"]).withColumn("group", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("groups"))).drop("first", "groups", "d")
    rows = scratch.stash(rows, "pruned-groups")
    asked = with_cells(queries.where("query_id is not null").select(F.col("query_id").cast("long"), "q", *others), "q", pivots, True)
    asked = scratch.stash(asked if same is None else asked.where(F.col(same).isNotNull()), "pruned-queries")
    if least is not None:
        asked = asked.withColumn("radius", F.lit(math.sqrt(max(0.0, 2 - 2 * least))))
    else:
        first = scored(to_groups(asked.withColumn("radius", F.lit(4.0)), cells, others, True), rows, others, k, -1.0, apart)
        first = scratch.stash(vector_best(first, k), "pruned-first")
        bound = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("found")).where(F.col("found") >= k)
        asked = asked.join(bound.select("query_id", "worst"), "query_id", "left").withColumn("radius", F.when(F.col("worst").isNull(), 2.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")))))
    pairs = to_groups(asked, cells, others, False)
    found = scored(pairs, rows, others, k, -1.0 if least is None else least, apart)
    found = found if least is None else found.where(F.col("score") >= least)
    rings = rows.groupBy(*others, "group", "cell", "ring").agg(F.count("*").alias("n"))
    work = pairs.select("query_id", *others, "group", F.explode("needs").alias("c")).select("query_id", *others, "group", "c.*").join(rings, [*others, "group", "cell"]).where("ring between low and high")
    return vector.best(found, k), work.select("query_id", "group", "cell", "ring", "n")


def vector_best(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best, not rounded."""
    own = F.row_number().over(vector.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", own).where(F.col("place") <= k).drop("place")
