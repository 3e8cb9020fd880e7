"""Streams: first sightings of fingerprints with a time to live, a sliding rate limit, windowed counts, alert windows from the first alert, micro-batches to sinks."""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylog.functions import text as X


def rocks_db(spark: SparkSession) -> None:
    """State in RocksDB on the executors' disks, with its changes in the checkpoint: what keyed processors need, and what holds more keys than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def micros(times: pd.Series) -> np.ndarray:
    return times.dt.as_unit("us").astype("int64").to_numpy()


def instants(values: list[int]) -> pd.Series:
    """Times that Spark takes for instants, whatever the session's zone."""
    return pd.Series(pd.to_datetime(np.array(values, np.int64), unit="us", utc=True))


class FirstSightings(StatefulProcessor):
    """Of one fingerprint: when it was last taken for new. A timer drops that once the watermark has passed its time to live."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = self.first.get()[0] if self.first.exists() else None
        before, out = first, []
        batch = pd.concat(rows)
        batch = batch.assign(at=micros(batch["ts"])).sort_values(["at", "log_id"], kind="stable")
        for row in batch.itertuples(index=False):
            if first is None or row.at >= first + self.ttl:
                first = row.at
                out.append((key[0], row.log_id, row.at))
        if first != before:
            self.first.update((first,))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-(first + self.ttl) // 1000))
        yield pd.DataFrame({"fingerprint": pd.Series([r[0] for r in out], dtype=object), "log_id": pd.Series([r[1] for r in out], dtype="int64"), "ts": instants([r[2] for r in out])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        yield pd.DataFrame({"fingerprint": pd.Series(dtype=object), "log_id": pd.Series(dtype="int64"), "ts": instants([])})


def first_seen(logs: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each service's fingerprint once within the time that the state is kept, in event time. logs: ts as timestamp, service, message."""
    marked = logs.withColumn("fingerprint", X.fingerprint(F.col("service").cast("string"), F.col("message"))).where("fingerprint <> ''")
    return marked.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def new_sightings(logs: DataFrame, ttl: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """fingerprint, log_id, ts of each fingerprint that is new: not seen before, or its last new sighting is a time to live or more ago, in event time.

    logs: ts as timestamp, log_id, service, message. A row is judged in the batch it comes in; one that is late, but not too late, and older than the sighting
    on record is not new. A fingerprint is a key of its own, so a hot service is spread.
    """
    rocks_db(logs.sparkSession)
    marked = logs.withColumn("fingerprint", X.fingerprint(F.col("service").cast("string"), F.col("message"))).where("fingerprint <> ''")
    rows = marked.withWatermark("ts", late).select("fingerprint", "ts", "log_id").groupBy("fingerprint")
    return rows.transformWithStateInPandas(FirstSightings(seconds_of(ttl)), "fingerprint string, log_id long, ts timestamp", "Append", "EventTime")


class SlidingLimit(StatefulProcessor):
    """Of one key: requests that wait for the watermark, and the times of those before that still count."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.recent = handle.getListState("recent", "at long, n long")  # requests of one time are one entry

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [x for batch in rows for x in zip(micros(batch["ts"]).tolist(), batch["id"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(at for at, _ in new) // 1000))
        yield self.rows(key, [], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, recent = sorted(self.waiting.get()), sorted(self.recent.get())
        cut = bisect.bisect_right(waiting, (passed, math.inf))
        due, rest = waiting[:cut], waiting[cut:]
        merged = Counter(dict(recent))
        for at, _ in due:
            merged[at] += 1
        times = np.array(sorted(merged), np.int64)
        upto = np.concatenate([[0], np.cumsum([merged[t] for t in times.tolist()])])
        own = np.array([at for at, _ in due], np.int64)
        # a rejected request counts for those after it, as one that was let through
        counts = upto[np.searchsorted(times, own, side="right")] - upto[np.searchsorted(times, own - self.width, side="right")]
        yield self.rows(key, [i for _, i in due], own.tolist(), counts.tolist())
        kept = [(int(t), int(merged[t])) for t in times.tolist() if t > passed - self.width]
        (self.waiting.put([tuple(map(int, x)) for x in rest]) if rest else self.waiting.clear())
        (self.recent.put(kept) if kept else self.recent.clear())
        ahead = [*(x[0] for x in rest[:1]), *([kept[-1][0] + self.width] if kept else [])]
        if ahead:
            self.handle.registerTimer(max(-(-min(ahead) // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def rows(self, key, ids: list[int], times: list[int], counts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(ids), dtype=object), "id": pd.Series(ids, dtype="int64"), "ts": instants(times), "in_window": pd.Series(counts, dtype="int64"), "limited": pd.Series([n > self.limit for n in counts], dtype=bool)})


def rate_limit(requests: DataFrame, limit: int, seconds: int, late: str = "10 seconds") -> DataFrame:
    """key, id, ts, in_window, limited: what timeseries.rate_flags says of a batch, of a stream of requests (key, id, ts).

    in_window is how many requests of the key, rejected ones included, lie in the last seconds up to this one. A request is judged when the watermark has passed it, so that
    those that come late, but within the lateness, are counted. State: a key's requests of a window and of the lateness.
    """
    rocks_db(requests.sparkSession)
    rows = requests.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.col("id").cast("long").alias("id")).groupBy("key")
    return rows.transformWithStateInPandas(SlidingLimit(limit, seconds), "key string, id long, ts timestamp, in_window long, limited boolean", "Append", "EventTime")


def seconds_of(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds())


def counts(logs: DataFrame, width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows by level in tumbling windows, or sliding ones; a window is emitted when the watermark has passed it."""
    spot = F.window("ts", width, slide) if slide else F.window("ts", width)
    return logs.withWatermark("ts", late).groupBy(spot, "level").agg(F.count("*").alias("count")).select(F.col("window.start").alias("bucket"), "level", "count")


def alert_windows(alerts: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """key, opened, alerts: windows that open at a key's first alert and last so many seconds; emitted when they have passed.

    The state of a key is its open window's start and count; a timer of the watermark closes it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, opened, n = [], *(state.get if state.exists else (None, 0))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "opened": [opened], "alerts": [n]})
            return
        times = sorted(t for b in batches for t in (b["ts"].astype("int64") // 1000 if b["ts"].dt.unit == "ns" else b["ts"].astype("int64")))
        for t in (int(t) // 1_000_000 for t in times):
            if opened is not None and t >= opened + seconds:
                out.append((key[0], opened, n))
                opened = None
            opened, n = (t, 1) if opened is None else (opened, n + 1)
        if opened is not None:
            state.update((opened, n))
            state.setTimeoutTimestamp(max((opened + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "opened", "alerts"])

    return alerts.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, opened long, alerts long", "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def to_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 minutes") -> DataStreamWriter:
    """A writer that hands each micro-batch to a function, on a clock or, without one, over what there is."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
