"""Resharding: flows against all ways to send small amounts, and laid-out corpora before and after."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import reshard
from quarrylog.sources.scratch import scratch

SF = "/root/testdata/sf0.001"


def cheapest(supplies, capacities, cost):
    """The least cost over all ways to send unit by unit."""
    units = [i for i, n in enumerate(supplies) for _ in range(n)]
    best = None
    for to in itertools.product(range(len(capacities)), repeat=len(units)):
        if all(to.count(j) <= c for j, c in enumerate(capacities)):
            price = sum(cost[i][j] for i, j in zip(units, to, strict=True))
            best = price if best is None else min(best, price)
    return best


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(150):
        supplies = [rng.randint(0, 2) for _ in range(rng.randint(1, 3))]
        capacities = [rng.randint(0, 4) for _ in range(rng.randint(1, 4))]
        cost = np.array([[rng.randint(0, 5) for _ in capacities] for _ in supplies])
        if sum(supplies) > sum(capacities):
            with pytest.raises(ValueError):
                reshard.min_cost_flow(supplies, capacities, cost)
            continue
        flow = reshard.min_cost_flow(supplies, capacities, cost)
        assert (flow >= 0).all() and flow.sum(1).tolist() == supplies and (flow.sum(0) <= capacities).all()
        assert (flow * cost).sum() == cheapest(supplies, capacities, cost)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(6)
    for n, m in ((12, 16), (16, 12), (40, 40), (100, 130)):
        supplies = [rng.randint(0, 10**12) for _ in range(n)]
        capacities = reshard.even(sum(supplies), m)
        flow = reshard.min_cost_flow(supplies, capacities)
        stay = sum(int(flow[i, i]) for i in range(min(n, m)))
        assert stay == sum(min(s, c) for s, c in zip(supplies, capacities, strict=False))
        assert flow.sum(0).tolist() == capacities


def held(spark, folder, generation, shards):
    """The rows of a generation, after a look at slots and sizes."""
    rows = reshard.read(spark, folder, generation).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    sizes = [sum(r["size"] for r in rows if r["shard"] == i) for i in range(shards)]
    return sorted((tuple(r["row"]) for r in rows), key=repr), sizes, {(r["row"]["doc_id"], r["row"]["text"], r["slot"]): r["shard"] for r in rows}


@pytest.fixture(scope="module")
def docs(spark):
    """A text with a third of all rows, all alike; nulls, empty texts, long ones, and columns of the module's own names."""
    rows = [(i, f"text {i} " + "word " * (i % 40), i % 3) for i in range(600)] + [(7, "the same again", 1)] * 600 + [(None, None, None)] * 5 + [(5, "", 0), (6, "", 0), (8, "é" * 3000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns({"row": F.lit("r"), "block": F.col("doc_id")})


def test_grows_and_shrinks_with_few_files_written(spark, docs):
    folder = scratch(spark, "reshard-test")
    reshard.lay_out(docs, folder, 6)
    want = sorted((tuple(r) for r in docs.collect()), key=repr)
    before, old_sizes, _ = held(spark, folder, 0, 6)
    assert before == want
    total = sum(old_sizes)
    reshard.reshard(spark, folder, 0, reshard.even(total, 8))
    after, sizes, _ = held(spark, folder, 1, 8)
    assert after == want and max(sizes) - min(sizes) < 0.03 * total / 8
    files = reshard.manifest(spark, folder, 1)
    moved = sum(max(0, s - total / 8) for s in old_sizes)
    kept = files.where("generation = 0").agg(F.sum("bytes")).first()[0]
    assert kept > 0.8 * (total - moved)  # files that nothing left are the old ones
    came = files.where("shift_right_block <> shard".replace("shift_right_block", "shiftright(block, 40)")).agg(F.sum("bytes")).first()[0]
    assert abs(came - moved) < 0.03 * total
    reshard.reshard(spark, folder, 1, [total, 0, total // 4, 0])
    again, sizes, _ = held(spark, folder, 2, 4)
    assert again == want and sizes[1] == sizes[3] == 0
    assert held(spark, folder, 0, 6)[0] == want  # readers of an old generation still find it
    reshard.vacuum(spark, folder, 2)
    assert held(spark, folder, 2, 4)[0] == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        reshard.manifest(spark, folder, 0).count()


def test_equal_texts_stay_together_but_for_large_groups(spark, docs):
    folder = scratch(spark, "reshard-test")
    few = docs.where("text <> 'the same again' or text is null")
    reshard.lay_out(few.unionAll(few), folder, 5)
    total = reshard.manifest(spark, folder, 0).agg(F.sum("bytes")).first()[0]
    reshard.reshard(spark, folder, 0, reshard.even(total, 6))
    spread = reshard.read(spark, folder, 1).groupBy("row.text").agg(F.sum("size").alias("bytes"), F.countDistinct("shard").alias("shards"))
    assert spread.where(F.col("bytes") <= total // (5 * reshard.BLOCKS)).agg(F.max("shards")).first()[0] == 1


def test_empty_table_and_failed_commit(spark, docs):
    folder = scratch(spark, "reshard-test")
    reshard.lay_out(docs.where("false"), folder, 3)
    reshard.reshard(spark, folder, 0, [0, 0])
    assert reshard.read(spark, folder, 1).count() == 0
    with pytest.raises(RuntimeError):
        reshard.reshard(spark, folder, 0, [0, 0])


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = reshard.op12_resharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(len(t or "") for t in docs.values())
