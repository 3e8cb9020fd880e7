"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees, within labels.

Unit vectors at cosine c lie sqrt(2 - 2 c) apart, so cosine 0.98 is distance 0.2. Vectors that repeat become one with a
weight. Each label's vectors are dealt to blocks by the nearest of some pivots, split by a hash to a bounded size; pairs of
blocks whose pivots are further apart than both covering radii and the threshold are pruned before any vector
moves. A task gets one pair of blocks, builds a cover tree of each (nested levels, halving radii) and walks both at once:
node pairs too far apart for their covering radii are pruned, those that lie within the threshold altogether are
counted without looking at their vectors, and leaf pairs are verified by the cosine in double precision.
Links are summed per vector; a spanning set of each task's links goes to the components.

Nulls, ties, empty inputs: null labels, null or zero vectors, vectors with null or non-finite components and rows without
vec_id link with nothing and are their own component; vectors of different lengths don't link; rows that repeat a vector
count as others each, and so do different vectors that share a vec_id; the smallest vec_id names a component and is kept; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.shared import components, small, stash

#: Vectors of a block at most, about.
BLOCK = 2048


class CoverTree:
    """levels[i]: (centres, covering radii, first child, end of children) with radii of nets halving from level to level.

    Children of a node follow each other in the next level. Points are renumbered by order so that the members of any node
    are a stretch of order: low[i] to high[i].
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        stretches, radius, self.levels = [(0, len(x))], 2.0, []
        while True:
            nodes = []
            for low, high in stretches:
                own = self.order[low:high]
                nodes.append((int(own[0]), float(self.distance(own[0], own).max()), low, high))
            centre, cover, low, high = (np.array(c) for c in zip(*nodes, strict=True))
            self.levels.append({"centre": centre, "cover": cover, "low": low, "high": high})
            if (high - low).max() == 1 or cover.max() == 0 or radius < 1e-7:
                break
            radius /= 2
            split, first = [], []
            for lo, hi in stretches:
                first.append(len(split))
                split += self.split(lo, hi, radius)
            self.levels[-1] |= {"first": np.array(first), "end": np.array([*first[1:], len(split)])}
            stretches = split

    def distance(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((self.x[others] - self.x[i]) ** 2).sum(1)))

    def split(self, low: int, high: int, radius: float, batch: int = 64) -> list[tuple[int, int]]:
        """Reorders a stretch into stretches around net centres that lie further than radius apart; each member is within radius of its centre."""
        own = self.order[low:high]
        if len(own) == 1:
            return [(low, high)]
        owner = np.full(len(own), -1)
        n = 0
        while (rest := np.flatnonzero(owner < 0)).size:
            picked = []
            gram = self.x[own[rest[:batch]]] @ self.x[own[rest[:batch]]].T
            for k in range(len(gram)):
                if all(2 - 2 * gram[k, j] > radius * radius for j in picked):
                    picked.append(k)
            centres = rest[np.array(picked)]
            near = self.x[own[rest]] @ self.x[own[centres]].T
            best = near.argmax(1)
            inside = 2 - 2 * near[np.arange(len(rest)), best] <= radius * radius
            owner[rest[inside]] = n + best[inside]
            owner[centres] = n + np.arange(len(centres))
            n += len(centres)
        at = np.argsort(owner, kind="stable")
        self.order[low:high] = own[at]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(owner[at]) > 0)), len(own))
        return [(low + a, low + b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def level(self, i: int) -> dict:
        return self.levels[min(i, len(self.levels) - 1)]


def dual(a: CoverTree, b: CoverTree, same: bool, least_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs (i of a, j of b) that link: single pairs, or (members, members, True) for node pairs that link altogether."""
    reach = float(np.sqrt(2 - 2 * least_cosine))
    left = right = np.zeros(1, np.int64)
    for i in range(max(len(a.levels), len(b.levels))):
        la, lb = a.level(i), b.level(i)
        keep = []
        for at in range(0, len(left), 1 << 15):
            p, q = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
            d = np.sqrt(((a.x[la["centre"][p]] - b.x[lb["centre"][q]]) ** 2).sum(1))
            keep.append(distant(d, la["cover"][p], lb["cover"][q], reach))
        state = np.concatenate(keep) if keep else np.empty(0, np.int8)
        for p, q in zip(left[state == 2], right[state == 2], strict=True):
            yield a.order[la["low"][p] : la["high"][p]], b.order[lb["low"][q] : lb["high"][q]], True
        left, right = left[state == 1], right[state == 1]
        if i + 1 >= max(len(a.levels), len(b.levels)):
            break
        new = [expanded(a, la, a.level(i + 1), p, b, lb, b.level(i + 1), q, same, reach) for p, q in zip(left, right, strict=True)]
        left, right = (np.concatenate([x[k] for x in new]) if new else np.empty(0, np.int64) for k in (0, 1))
    la, lb = a.levels[-1], b.levels[-1]
    for p, q in zip(left, right, strict=True):
        yield a.order[la["low"][p] : la["high"][p]], b.order[lb["low"][q] : lb["high"][q]], False


def distant(d: np.ndarray, ra: np.ndarray, rb: np.ndarray, reach: float) -> np.ndarray:
    """0: no vectors of the two nodes can link; 2: all do, with a margin for rounding; 1: look further."""
    return np.where(d > ra + rb + reach + 1e-6, 0, np.where(d + ra + rb < reach - 1e-6, 2, 1)).astype(np.int8)


def expanded(a: CoverTree, la: dict, na: dict, p: int, b: CoverTree, lb: dict, nb: dict, q: int, same: bool, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of two nodes that are near enough; within one tree each pair once."""
    i = np.arange(la["first"][p], la["end"][p]) if "first" in la else np.array([p])
    j = np.arange(lb["first"][q], lb["end"][q]) if "first" in lb else np.array([q])
    near = a.x[na["centre"][i]] @ b.x[nb["centre"][j]].T
    bound = na["cover"][i][:, None] + nb["cover"][j][None, :] + reach + 1e-6
    ok = np.maximum(0, 2 - 2 * near) <= bound * bound + 1e-9
    if same and p == q:
        ok &= i[:, None] <= j[None, :]
    x, y = np.nonzero(ok)
    return i[x], j[y]


def block_links(pdf: pd.DataFrame, least_cosine: float) -> pd.DataFrame:
    """One pair of blocks -> id, links, root: how many rows each vector links with here, and a representative of what it is linked to."""
    first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = len(second) == 0
    if not len(first):
        return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
    raw = [np.stack(s["embedding"].to_numpy()).astype(np.float64) for s in ((first,) if same else (first, second))]
    norms = [np.sqrt((r * r).sum(1)) for r in raw]
    trees = [CoverTree(r / n[:, None]) for r, n in zip(raw, norms, strict=True)]
    ids = np.concatenate([first["id"].to_numpy(), second["id"].to_numpy()]).astype(np.int64)
    weight = np.concatenate([first["copies"].to_numpy(), second["copies"].to_numpy()]).astype(np.int64)
    shift = 0 if same else len(first)
    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    for i, j, sure in dual(trees[0], trees[-1], same, least_cosine):
        own = same and i[0] == j[0]
        if sure:
            j = j + shift
            links[i] += weight[j].sum() - (weight[i] if own else 0)
            if not own:
                links[j] += weight[i].sum()
            for k in (*i[1:], *j):
                unite(int(i[0]), int(k))
            continue
        cosine = (raw[0][i] @ raw[-1][j].T) / (norms[0][i][:, None] * norms[-1][j][None, :])
        x, y = np.nonzero(cosine >= least_cosine)
        if own:
            x, y = x[x < y], y[x < y]
        for s, t in zip(i[x], j[y] + shift, strict=True):
            links[s] += weight[t]
            links[t] += weight[s]
            unite(int(s), int(t))
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[[root(int(k)) for k in some]] if len(some) else ids[:0]})


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their key (null where a row links with nothing), and one row for each label and vector: key, label, id, copies, embedding."""
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", "label").withColumn("key", F.when(fine, F.xxhash64(F.col("label").cast("string"), F.transform("embedding", lambda v: v + F.lit(0.0)))))  # adding 0 makes -0 and 0 alike
    own = rows.where("key is not null").groupBy("key", F.col("label").cast("string").alias("label")).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    own = own.join(rows.select(F.col("vec_id").alias("id"), F.col("key").alias("own"), "embedding"), "id").where("own = key").drop("own").dropDuplicates(["key"])
    return rows.select("vec_id", "key"), own


def blocks_of(own: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """own -> its rows with space, cell and block, and the pairs of blocks that the pivots' covering radii don't exclude.

    A space is a label and a vector length. It has one pivot for each block's worth of rows, up to 32, those of smallest hash.
    """
    own = own.withColumn("space", F.concat_ws("/", F.size("embedding"), "label")).withColumn("h", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(1 << 40)) / float(1 << 40))
    sizes = small(stash(own.groupBy("space").agg(F.count("*").alias("n")), "spaces"), 100_000)
    own = own.join(sizes, "space")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    unit = F.transform("embedding", lambda v: v / F.col("norm"))
    own = own.withColumn("norm", norm).withColumn("unit", unit)
    wanted = F.least(F.lit(32), F.ceil(F.col("n") / block))
    pivots = own.where(F.col("n") > block).where(F.col("h") < wanted / F.col("n")).groupBy("space").agg(F.sort_array(F.collect_list(F.struct("h", "unit"))).alias("pivots"))
    pivots = small(stash(pivots, "pivots"), 2_000)  # about 32 in each
    dot = lambda p: F.aggregate(F.zip_with(p["unit"], F.col("unit"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    far = F.array_min(F.transform("pivots", lambda p, i: F.struct((2 - 2 * dot(p)).alias("d2"), i.alias("cell"))))
    own = own.join(pivots, "space", "left").withColumn("near", far).withColumn("cell", F.coalesce("near.cell", F.lit(0))).withColumn("d", F.sqrt(F.greatest(F.coalesce("near.d2", F.lit(4.0)), F.lit(0.0))))
    own = stash(own.select("space", "id", "copies", "embedding", "cell", "d", "h", "n", F.get(F.col("pivots"), F.col("cell"))["unit"].alias("pivot")), "placed")
    cells = own.groupBy("space", "cell").agg(F.count("*").alias("m"), F.max("d").alias("radius"), F.first("pivot").alias("pivot"))
    cells = stash(cells.withColumn("split", F.ceil(F.col("m") / block)), "cells")
    placed = own.join(small(cells.select("space", "cell", "split"), 100_000), ["space", "cell"]).withColumn("part", F.floor(F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 30)) * F.col("split") / (1 << 30)))
    each = cells.select("*", F.explode(F.sequence(F.lit(0), (F.col("split") - 1).cast("int"))).alias("part"))
    two = lambda x: each.select("space", *[F.col(c).alias(f"{c}_{x}") for c in ("cell", "part", "radius", "pivot")])
    apart = F.sqrt(F.aggregate(F.zip_with("pivot_a", "pivot_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    pairs = two("a").join(two("b"), "space").where("cell_a < cell_b or cell_a = cell_b and part_a <= part_b")
    return placed, pairs.withColumn("apart", F.coalesce(apart, F.lit(0.0)))


def link(vectors: DataFrame, least_cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    rows, own = distinct_vectors(vectors)
    own = stash(own.withColumnRenamed("id", "smallest").withColumn("id", F.col("key")), "vectors")  # vectors go by their keys, as a vec_id may repeat
    reach = float(np.sqrt(2 - 2 * least_cosine))
    placed, pairs = blocks_of(own, block)
    pairs = pairs.where(F.col("apart") <= F.col("radius_a") + F.col("radius_b") + reach + 1e-6).withColumn("task", F.concat_ws("/", "space", "cell_a", "part_a", "cell_b", "part_b"))
    ends = pairs.select("task", "space", F.col("cell_a").alias("cell"), F.col("part_a").alias("part"), F.lit(0).alias("side")).union(pairs.where("cell_a <> cell_b or part_a <> part_b").select("task", "space", "cell_b", "part_b", F.lit(1)))
    dealt = placed.join(ends, ["space", "cell", "part"]).select("task", "side", "id", "copies", "embedding")
    found = stash(dealt.groupBy("task").applyInPandas(lambda pdf: block_links(pdf, least_cosine), "id long, links long, root long"), "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = own.select("key", "id", "smallest", "copies").join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = known.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = known.join(first, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
with e as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
c as (with recursive r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a) select a, min(b) as component_id from r group by a)
select m.vec_id, (select count(*) from p where p.a = m.vec_id)::bigint as n_links, c.component_id, coalesce(m.vec_id = c.component_id, false) as kept from embeddings m left join c on c.a = m.vec_id
"""
