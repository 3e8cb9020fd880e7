"""Stages: counts in one plan, skips, optional failures and aborts."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import reports, stages
from quarrylog.operators.stages import Stage


def boom(df):
    return df.withColumn("x", F.raise_error(F.lit("no such model")).cast("int"))


def test_counts_of_fused_stages(spark):
    out, metrics = stages.run(spark.range(100), [Stage("even", lambda d: d.where("id % 2 = 0")), Stage("double", lambda d: d.union(d)), Stage("large", lambda d: d.where("id >= 50"), measures={"most": F.max("id")})])
    assert out.count() == 50
    assert [(m["stage"], m["status"], m["rows"]) for m in metrics] == [("even", "ok", 50), ("double", "ok", 100), ("large", "ok", 50)]
    assert metrics[2]["most"] == 98 and all(m["duration_ms"] >= 0 and m["error"] is None for m in metrics)


def test_an_optional_stage_that_fails_is_passed_over(spark):
    """When its plan is built, and when it runs."""
    for bad in (boom, lambda d: d.select("nothing")):
        out, metrics = stages.run(spark.range(10), [Stage("a", lambda d: d.where("id > 2")), Stage("b", bad, critical=False), Stage("c", lambda d: d.where("id > 5")), Stage("d", lambda d: d.where("id > 6"), critical=False)])
        assert sorted(r["id"] for r in out.collect()) == [7, 8, 9]
        assert [(m["stage"], m["status"], m["rows"]) for m in metrics] == [("a", "ok", 7), ("b", "error", None), ("c", "ok", 4), ("d", "ok", 3)]
        assert metrics[1]["error"]


def test_a_critical_stage_aborts(spark):
    later = []
    for bad in (boom, lambda d: d.select("nothing")):
        with pytest.raises(stages.StageError) as e:
            stages.run(spark.range(10), [Stage("a", lambda d: d.where("id > 2"), critical=False), Stage("b", bad), Stage("c", lambda d: later.append(d) or d, critical=False)])
        assert e.value.stages == ["b"] and [m["status"] for m in e.value.metrics] == ["ok", "error"]
    assert not later


def test_skip_rules_see_what_stages_found(spark):
    known = Stage("known", lambda d: d.where("id < 0"))
    costly = Stage("costly", boom, skip=lambda facts: facts["rows_known"] == 0 or facts.get("dedup_hit", False))
    out, metrics = stages.run(spark.range(10), [known, costly])
    assert out.count() == 0 and [m["status"] for m in metrics] == ["ok", "skipped"]
    rows = spark.createDataFrame([(1, json.dumps(metrics))], "task_id int, stage_metrics string")
    assert reports.stage_durations(rows).first()["errors"] == []
