"""The sampler step by step, in memory: what the operator is held against."""

import collections
import math

import pandas as pd

from quarrylog.functions import values as V


def allocate(sizes: dict[str, int], budget: int) -> dict[str, int]:
    """Slots by severity: the least numbers, then shares by weight * log2(unfilled + 1), the rest where weight * size is largest."""
    slots = {s: min(V.SAMPLE_LEAST.get(s, 0), n) for s, n in sizes.items()}
    left = budget - sum(slots.values())
    if left > 0:
        scores = {s: V.SAMPLE_WEIGHT.get(s, 1.0) * math.log2(sizes[s] - slots[s] + 1) for s in sizes if sizes[s] > slots[s]}
        total = sum(scores.values())
        for s, x in scores.items():
            slots[s] += min(int(left * (x / total)), sizes[s] - slots[s])
        for s in sorted(sizes, key=lambda s: (-V.SAMPLE_WEIGHT.get(s, 1.0) * sizes[s], s)):
            slots[s] += max(0, min(budget - sum(slots.values()), sizes[s] - slots[s]))
    return slots


def take(rows: pd.DataFrame, slots: int) -> list[int]:
    """Row labels: from each group in turn its newest row whose message wasn't taken; ends with the first round that adds none."""
    if rows["of_severity"].iloc[0] <= slots:
        return list(rows.index)
    groups = [list(g.index) for _, g in rows.sort_values(["ts", "log_id"], ascending=False).groupby("group", sort=False)]
    hashes, taken, at = set(), [], 0
    while len(taken) < slots:
        before = len(taken)
        for g in groups:
            if at < len(g) and len(taken) < slots and (h := rows.at[g[at], "hash"]) not in hashes:
                hashes.add(h)
                taken.append(g[at])
        at += 1
        if len(taken) == before:
            break
    return taken


def draw(rows: list[tuple], budget: int) -> set:
    """rows (log_id, ts, severity, group, hash) of one task -> the log_ids taken."""
    frame = pd.DataFrame(rows, columns=["log_id", "ts", "severity", "group", "hash"])
    sizes = dict(collections.Counter(frame["severity"]))
    slots = sizes if sum(sizes.values()) <= budget else allocate(sizes, budget)
    frame["of_severity"] = frame["severity"].map(sizes)
    return {frame.at[i, "log_id"] for s, g in frame.groupby("severity") if slots[s] for i in take(g, slots[s])}
