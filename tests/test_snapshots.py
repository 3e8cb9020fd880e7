"""Tenants' tables under inserts, updates and deletes, against a dictionary; old versions while new ones are written."""

import random
import threading

import pytest

from quarrylog.sources import snapshots

SCHEMA = "id long, tenant_id string, status string, n int"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "new", i) for i in range(200)] + [(i, "c", "new", i) for i in range(50)]
    folder = str(tmp_path / "table")
    snapshots.create(spark.createDataFrame(rows, SCHEMA), folder, buckets=8)
    return folder, {(r[1], r[0]): (r[2], r[3]) for r in rows}


def rows(df):
    return {(r["tenant_id"], r["id"]): (r["status"], r["n"]) for r in df.collect()}


def test_changes_against_a_dictionary(spark, table):
    folder, want = table
    rng = random.Random(3)
    history = [dict(want)]
    for step in range(3):
        tenant = rng.choice("abc")
        own = [i for t, i in want if t == tenant]
        ids = rng.sample(range(260), 12)
        updates, deletes, new = ids[:5], ids[5:8], [1000 + 10 * step + j for j in range(4)]
        said = snapshots.change(
            spark, folder, tenant,
            inserts=spark.createDataFrame([(i, "ins", i) for i in new], "id long, status string, n int"),
            updates=spark.createDataFrame([(i, None if i % 2 else f"u{step}") for i in updates], "id long, status string"),
            deletes=spark.createDataFrame([(i,) for i in deletes], "id long"),
        )
        assert said == {"version": step + 1, "inserted": 4, "updated": len(set(updates) & set(own)), "deleted": len(set(deletes) & set(own))}
        for i in set(deletes) & set(own):
            del want[tenant, i]
        for i in set(updates) & set(own):
            want[tenant, i] = (None if i % 2 else f"u{step}", want[tenant, i][1])
        want |= {(tenant, i): ("ins", i) for i in new}
        history.append(dict(want))
        assert rows(snapshots.read(spark, folder)) == want
        assert rows(snapshots.read(spark, folder, tenant=tenant)) == {k: v for k, v in want.items() if k[0] == tenant}
    for version, old in enumerate(history):
        assert rows(snapshots.read(spark, folder, version)) == old


def test_only_touched_buckets_are_written(spark, table):
    folder, _ = table
    snapshots.change(spark, folder, "a", deletes=spark.createDataFrame([(0,)], "id long"))
    old, new = (snapshots.manifest(spark, folder, v) for v in (0, 1))
    assert [r["tenant"] for r in new.exceptAll(old).collect()] in ([], ["a"]) and old.exceptAll(new).count() == 1
    plan = snapshots.read(spark, folder, tenant="a")._jdf.queryExecution().toString()
    assert "tenant" in plan.split("PartitionFilters")[1].split("]")[0]


def test_refused_changes_leave_the_table(spark, table):
    folder, want = table
    frame = lambda *r: spark.createDataFrame(r, "id long, status string, n int")
    with pytest.raises(ValueError, match="inserted"):
        snapshots.change(spark, folder, "a", inserts=frame((0, "x", 1)))
    with pytest.raises(ValueError, match="inserted"):
        snapshots.change(spark, folder, "a", inserts=frame((900, "x", 1), (900, "y", 1)))
    with pytest.raises(ValueError, match="twice"):
        snapshots.change(spark, folder, "a", updates=frame((0, "x", 1), (0, "y", 1)))
    assert snapshots.latest(spark, folder) == 0 and rows(snapshots.read(spark, folder)) == want
    said = snapshots.change(spark, folder, "nobody", updates=frame((0, "x", 1)))
    assert (said["updated"], rows(snapshots.read(spark, folder))) == (0, want)


def test_old_version_is_read_while_a_new_one_is_written(spark, table):
    folder, want = table
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(len(rows(snapshots.read(spark, folder))))

    reader = threading.Thread(target=look)
    reader.start()
    snapshots.change(spark, folder, "a", deletes=spark.createDataFrame([(i,) for i in range(0, 100, 2)], "id long"))
    stop.set()
    reader.join()
    assert set(seen) <= {250, 200} and len(seen) > 1
    assert rows(snapshots.read(spark, folder, 0)) == want


def test_of_two_writers_the_later_fails(spark, table, monkeypatch):
    folder, want = table
    put = snapshots._put

    def slow(kept, where):
        out = put(kept, where)
        monkeypatch.setattr(snapshots, "_put", put)
        snapshots.change(spark, folder, "b", deletes=spark.createDataFrame([(1,)], "id long"))
        return out

    monkeypatch.setattr(snapshots, "_put", slow)
    with pytest.raises(RuntimeError, match="first"):
        snapshots.change(spark, folder, "a", deletes=spark.createDataFrame([(0,)], "id long"))
    assert rows(snapshots.read(spark, folder)) == {k: v for k, v in want.items() if k != ("b", 1)}


def test_pages_with_totals(spark, table):
    folder, _ = table
    own = snapshots.read(spark, folder, tenant="c")
    got, total, pages = snapshots.page(own, 20, 10, "n", True, status="new", nothing="x")
    assert ([r["id"] for r in got.collect()], total, pages) == (list(range(29, 19, -1)), 50, 5)
