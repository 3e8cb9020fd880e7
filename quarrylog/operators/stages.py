"""Stages over a DataFrame with metrics, skip rules and abort rules.

Critical stages are fused: one plan, run once, with Spark's observations counting what each hands on. An optional stage that fails must not
take them with it, so what comes before one is written to the shared folder first, and the stage runs on that alone; if it fails,
the run goes on from there. Metrics have the form that reports.stage_durations reads: stage, duration_ms, status (ok, skipped, error), error, and rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarrylog.sources import scratch


@dataclass(frozen=True)
class Stage:
    """apply makes the next rows from those before; skip looks at the facts that the run was given or that stages before have set."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    critical: bool = True
    skip: Callable[[dict], bool] | None = None
    measures: dict = field(default_factory=dict)  # further aggregates to observe, by name


class StageError(RuntimeError):
    """A critical stage failed. metrics: those of all stages up to it."""

    def __init__(self, stages: list[str], cause: Exception, metrics: list[dict]):
        super().__init__(f"stage {' or '.join(stages)} failed: {str(cause)[:500]}")
        self.stages, self.metrics = stages, metrics


def run(df: DataFrame, stages: list[Stage], facts: dict | None = None) -> tuple[DataFrame, list[dict]]:
    """The rows after all stages, as a table in the shared folder, and a metric for each stage.

    Stages that are fused share the duration of their plan, by which each of them is charged the same part. facts gets rows_<stage> of each plan that has run.
    """
    facts, metrics, open_ = {} if facts is None else facts, [], []

    def metric(stage: Stage, status: str, began: float, error: Exception | None = None) -> dict:
        metrics.append({"stage": stage.name, "duration_ms": int((time.monotonic() - began) * 1000), "status": status, "error": None if error is None else str(error)[:500], "rows": None})
        return metrics[-1]

    def observed(stage: Stage, rows: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in stage.measures.items()]), seen

    def note(stage: Stage, own: dict, seen: Observation) -> None:
        own |= seen.get
        facts[f"rows_{stage.name}"] = own["rows"]

    def settle(rows: DataFrame) -> DataFrame:
        """Runs what is fused so far."""
        if not open_:
            return rows
        began = time.monotonic()
        try:
            out = scratch.stash(rows, "stages")
        except Exception as e:
            for _, own, _ in open_:
                own |= {"status": "error", "error": str(e)[:500]}
            raise StageError([s.name for s, _, _ in open_], e, metrics) from e
        part = int((time.monotonic() - began) * 1000) // len(open_)
        for stage, own, seen in open_:
            note(stage, own, seen)
            own["duration_ms"] += part
        open_.clear()
        return out

    rows = df
    for stage in stages:
        if not stage.critical or stage.skip:  # a skip rule may ask for what is fused
            rows = settle(rows)
        began = time.monotonic()
        if stage.skip and stage.skip(facts):
            metric(stage, "skipped", began)
            continue
        if stage.critical:
            try:
                rows, seen = observed(stage, stage.apply(rows))
            except Exception as e:
                metric(stage, "error", began, e)
                raise StageError([stage.name], e, metrics) from e
            open_.append((stage, metric(stage, "ok", began), seen))
            continue
        try:
            tried, seen = observed(stage, stage.apply(rows))
            tried = scratch.stash(tried, "stages")
        except Exception as e:  # an optional stage may fail in any way
            metric(stage, "error", began, e)
            continue
        rows = tried
        note(stage, metric(stage, "ok", began), seen)
    return settle(rows), metrics
