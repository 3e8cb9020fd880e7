import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylog.operators import dedup, prefixes, sampling, timeseries, tools, vector
from quarrylog.streaming import stateful
from tests import sampling_brute

START = datetime.datetime(2024, 1, 1)


def series(spark, counts):
    rows = [(START + datetime.timedelta(minutes=i), c) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "bucket timestamp_ntz, count long")


@pytest.mark.parametrize(
    ("counts", "hits"),
    [([10] * 60, []), ([5] * 40 + [200] + [5] * 19, [200]), (list(range(1, 61)), []), ([5] * 35 + [100] + [5] * 10 + [150] + [5] * 13, [100]), ([10] * 5, []), ([0] * 60, []), ([5] * 59 + [500], [500]), ([0] * 50 + [50] + [0] * 9, [50])],
)
def test_change_points(spark, counts, hits):
    found = timeseries.change_points(series(spark, counts)).orderBy("bucket").collect()
    assert [r["count"] for r in found][: len(hits)] == hits
    assert bool(found) == bool(hits)


@pytest.mark.parametrize(("counts", "kind"), [([10] * 60, "stable"), ([5] * 20 + [10] * 20 + [20] * 20, "increasing"), ([50] * 20 + [30] * 20 + [10] * 20, "declining"), ([0] * 50 + [50] + [0] * 9, "spike"), ([0] * 60, "stable"), ([1] * 5, "unknown")])
def test_trends(spark, counts, kind):
    assert timeseries.trend(series(spark, counts)).first()["trend"] == kind


def test_fill_covers_the_calendar(spark):
    holes = series(spark, [1] * 10).where(F.minute("bucket") % 3 == 0)
    assert [r["count"] for r in timeseries.fill(holes, "1 minute").orderBy("bucket").collect()] == [1, 0, 0, 1, 0, 0, 1, 0, 0, 1]


def test_windows_open_at_the_first_alert(spark):
    rows = [("a", START + datetime.timedelta(seconds=s)) for s in (0, 100, 299, 300, 301, 700)]
    found = timeseries.first_in_window(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), 300, "k").orderBy("opened").collect()
    assert [((r["opened"] - START).seconds, r["alerts"]) for r in found] == [(0, 3), (300, 2), (700, 1)]


def test_stack_merge(spark):
    lines = [(1, 0, "a"), (1, 1, "  at x.y("), (1, 2, "Caused by: z"), (1, 3, "b"), (2, 0, "  at lone(")]
    out = dedup.merge_stacks(spark.createDataFrame(lines, "f int, seq int, line string"), "f").orderBy("f", "seq").collect()
    assert [(r["message"], r["n_lines"]) for r in out] == [("a\n  at x.y(\nCaused by: z", 3), ("b", 1), ("  at lone(", 1)]


def test_compare(spark):
    kinds = "signature string, severity string, confidence double, seq int"
    base = [("same", "error", 0.5, 0), ("gone", "info", 0.5, 1), ("up", "warning", 0.5, 2), ("down", "critical", 0.5, 3), ("surer", "info", 0.3, 4), ("", "info", 0.1, 5)]
    other = [("same", "error", 0.6, 0), ("new", "info", 0.5, 1), ("up", "critical", 0.1, 2), ("down", "warning", 0.9, 3), ("surer", "info", 0.1, 4), ("surer", "info", 0.9, 5)]
    out = {r["signature"]: r["change"] for r in dedup.compare(spark.createDataFrame(base, kinds), spark.createDataFrame(other, kinds)).collect()}
    assert out == {"same": "unchanged", "gone": "resolved", "new": "new", "up": "worsened", "down": "improved", "surer": "worsened"}


def test_halving(spark):
    signals = spark.createDataFrame([("a", 0.8), ("b", 0.5), ("c", 0.9)], "id string, confidence double")
    out = dedup.halve(signals, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert {r["id"]: r["confidence"] for r in out.collect()} == {"a": 0.4, "c": 0.9}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(["CRITICAL", "ERROR", "WARN", "INFO", "DEBUG", "UNKNOWN"]), st.integers(1, 500), min_size=1), st.integers(30, 300))
def test_slots_fill_the_budget(sizes, budget):
    slots = sampling_brute.allocate(sizes, budget)
    assert all(0 <= slots[s] <= n for s, n in sizes.items())
    assert sum(slots.values()) == min(budget, sum(sizes.values()))


KINDS = "k int, log_id long, ts timestamp_ntz, level string, message string"


def test_sample_prefers_severe(spark):
    rows = [(1, i, START + datetime.timedelta(seconds=i), "CRITICAL" if i % 2 else "INFO", f"message number {i}") for i in range(200)]
    out = sampling.sample(spark.createDataFrame(rows, KINDS), 50, "k").collect()
    severe = [r for r in out if r["severity"] == "CRITICAL"]
    assert len(out) <= 50
    assert len(severe) > len(out) - len(severe)


def test_sample_is_diverse(spark):
    rows = [(1, i, START + datetime.timedelta(seconds=i), "ERROR", f"x.E{i % 20}Exception: {i}") for i in range(200)]
    out = sampling.sample(spark.createDataFrame(rows, KINDS), 50, "k").collect()
    assert len({r["group"] for r in out}) >= 15


def test_sample_equals_step_by_step(spark):
    """Random tasks of all kinds: one hot group, messages that repeat within a group and across groups, rounds that add nothing, few and many severities."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(12):
        levels = ["CRITICAL", "error", "WARN", "INFO", None, "odd"][: rng.integers(1, 7)]
        for i in range(int(rng.choice([15, 60, 150, 400]))):
            kind = rng.integers(0, 4)
            message = [f"x.E{rng.integers(3)}Exception: {rng.integers(4)}", f"plain {'abcdefgh'[rng.integers(8)]} text", "the same", f"x.HotError: {i}"][kind]
            rows.append((k, k * 1000 + i, START + datetime.timedelta(seconds=int(rng.integers(0, 50))), levels[rng.integers(len(levels))], message))
    logs = spark.createDataFrame(rows, KINDS)
    keyed = logs.select("k", "log_id", "ts", F.coalesce(F.upper("level"), F.lit("UNKNOWN")).alias("s"), sampling.X.group_key(F.col("message")).alias("g"), F.md5("message").alias("h")).collect()
    for budget in (20, 50, 120):
        got = {(r["k"], r["log_id"]) for r in sampling.sample(logs, budget, "k").collect()}
        want = {(k, i) for k in range(12) for i in sampling_brute.draw([tuple(r)[1:] for r in keyed if r["k"] == k], budget)}
        assert got == want


def test_slots_equal_step_by_step(spark):
    rng = np.random.default_rng(8)
    names = ["CRITICAL", "FATAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE", "UNKNOWN", "OTHER"]
    sizes = {k: {s: int(rng.integers(1, 400)) for s in names if rng.random() < 0.5} for k in range(200)}
    for budget in (20, 150):
        rows = spark.createDataFrame([(k, s, n) for k, x in sizes.items() for s, n in x.items()], "k int, severity string, n long")
        got = {(r["k"], r["severity"]): r["slots"] for r in sampling.slots(rows, budget, "k").collect()}
        want = {(k, s): m for k, x in sizes.items() for s, m in (x if sum(x.values()) <= budget else sampling_brute.allocate(x, budget)).items()}
        assert got == want


def test_small_tasks_are_taken_whole(spark):
    rows = [(k, i, START, None, "same") for k in (1, 2) for i in range(12)]
    assert sampling.sample(spark.createDataFrame(rows, KINDS), 50, "k").count() == 24


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(START + datetime.timedelta(seconds=s), "a", 1, f"x.IOException: {m}", "ERROR") for s, m in ((0, "p"), (10, "p"), (20, "q"), (400, "p"), (90_000, "r"))]
    spark.createDataFrame(rows, "ts timestamp, key string, service int, message string, level string").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("ts timestamp, key string, service int, message string, level string").parquet(source)
    got = {}

    def run(name, df):
        def sink(batch, _):
            got.setdefault(name, []).extend(batch.collect())

        stateful.to_batches(df, sink, str(tmp_path / name), every=None).start().awaitTermination()

    run("seen", stateful.first_seen(stream()))
    assert sorted(r["message"] for r in got["seen"]) == ["x.IOException: p", "x.IOException: q", "x.IOException: r"]
    run("counts", stateful.counts(stream()))
    assert sorted(r["count"] for r in got["counts"]) == [1, 3]
    run("alerts", stateful.alert_windows(stream()))
    assert (int(START.replace(tzinfo=datetime.timezone.utc).timestamp()), 3) in [(r["opened"], r["alerts"]) for r in got["alerts"]]


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)] if i % 9 else [1.0, 0.0, 0.0, 0.0], i % 3) for i in range(90)]
    library = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    queries = library.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("ql"))
    asked = lambda: sorted(map(tuple, vector.knn(queries, library, 3, 0.1, (F.col("vec_id") != F.col("query_id")) & (F.col("label") == F.col("ql"))).collect()))
    similar = lambda: sorted(map(tuple, tools.similar_incidents(queries.select("query_id", "q"), library.select("vec_id", "v")).collect()))
    whole, incidents = asked(), similar()
    monkeypatch.setattr(vector, "MOST_QUERIES", 16)
    assert asked() == whole and len({r[0] for r in whole}) > 16
    assert similar() == incidents and len(incidents) == 3 * 45


def test_tiles_give_the_same_neighbours(spark, monkeypatch):
    """Ties, repeated rows, null, zero, short and non-finite vectors, null ids and labels, against the plain search."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], i % 3 if i % 7 else None) for i in range(200)]
    rows += [(300, None, 1), (301, [0.0, 0.0, 0.0], 1), (302, [1.0, 2.0], 1), (303, [2.0, 1.0], 1), (304, [1.0, None, 1.0], 1), (3, rows[3][1], rows[3][2])]
    library = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    queries = library.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label"))
    near = lambda df: sorted(map(tuple, df.collect()))
    on = (F.col("vec_id") != F.col("query_id")) & (F.col("label") == F.col("ql"))
    want = near(vector.knn(queries.withColumnRenamed("label", "ql"), library, 4, 0.2, on))
    everywhere = near(vector.knn(queries.drop("label"), library.drop("label"), 4))
    monkeypatch.setattr(vector, "TILE", 16)
    assert near(vector.knn_by_tiles(queries, library, 4, 0.2, "label", True)) == want and len(want) > 200
    assert near(vector.knn_by_tiles(queries, library, 4)) == everywhere
    lone = spark.createDataFrame([(None, [1.0, 0.0, 0.0], 1), (9, [float("nan"), 0.0, 0.0], 1)], "vec_id long, v array<float>, label int")
    assert near(vector.knn_by_tiles(queries, lone, 4)) == []
    assert near(vector.knn_by_tiles(queries.where("false"), library, 4, same="label")) == []
    assert near(vector.knn_by_tiles(queries.where("false"), library, 4)) == []


def test_prefixes_of_many_known_texts(spark):
    """More known texts than were taken before, repeated rows, non-ASCII texts, runs of one character and both directions, against a search through all."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdé 漢😀\n"), n))
    known = [text(90) for _ in range(60)] + ["x" * 200, "y" * 79, None, " " * 80]
    docs = [text(50) + k[:80] + text(5) for k in known[:20]] + [known[5], known[5], "x" * 80, "x" * 79, " " * 300, None, "", text(3000) + known[30] + text(3000), known[31][:79] + "!", known[32][3:] + text(9)]
    known += [text(7) + d[:80] for d in docs[:9]] + [known[3], known[3]]
    d = spark.createDataFrame([(i % 25, t) for i, t in enumerate(docs)], "doc_id int, text string")
    b = spark.createDataFrame(list(enumerate(known)), "item_id int, text string")
    fine = lambda t: t is not None and len(t) >= 80
    want = sorted((i % 25, j) for i, s in enumerate(docs) for j, t in enumerate(known) if fine(s) and fine(t) and (t[:80] in s or s[:80] in t))
    assert sorted(map(tuple, prefixes.matches(d, b).collect())) == want and len(want) > 30
    others = spark.range(10_100).select((F.col("id") + 1000).cast("int").alias("item_id"), F.concat(F.lit("#"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    assert sorted(map(tuple, prefixes.matches(d, b.union(others)).collect())) == want
    long, factors = text(70_000), [prefixes.powers(f) for f in (prefixes.FACTOR, pow(prefixes.FACTOR, -1, 1 << 64))]
    whole = set(prefixes.anchors(long, *factors).tolist())
    assert all(set(prefixes.anchors(long[i : i + 80], *factors).tolist()) < whole for i in range(65_400, 65_700))
