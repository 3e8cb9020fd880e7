"""Log search and statistics: severity channels, text, equality and wildcard filters, term counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V


def between(ts: Column, low, high, closed: bool = True) -> Column:
    """Closed at both ends, or open above."""
    return (ts >= F.lit(low)) & ((ts <= F.lit(high)) if closed else (ts < F.lit(high)))


def severity_filter(severity: str, levels: list[Column], loglevel: Column, filetype: Column, message: Column, learned: tuple[str, ...] = ()) -> Column:
    """A row of that severity by any level field, by its file type, by a marker in the message, or for errors by a signal of failure."""
    low = severity.lower()
    ways = [c == low for c in levels] + [loglevel == severity.upper(), filetype.isin(*V.SEVERITY_FILETYPES.get(low, ()), *(V.MIXED_FILETYPES if low in V.SEVERITY_FILETYPES else ()))]
    if low in ("error", "critical"):
        ways += [X.contains_any(message, V.ERROR_MARKERS), X.contains_any(message, V.STATIC_SIGNALS + tuple(s for s in learned if s not in V.STATIC_SIGNALS))]
    elif low == "warning":
        ways.append(X.contains_any(message, V.WARNING_MARKERS))
    return reduce(lambda a, b: a | b, (F.coalesce(w, F.lit(False)) for w in ways))


def text_filter(query: str, *fields: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(f).contains(query.lower()), F.lit(False)) for f in fields))


def wildcard(c: Column, value: str) -> Column:
    """Equality, or a pattern where the value holds *."""
    if "*" not in value:
        return c == value
    escaped = value.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return c.like(escaped.replace("*", "%"))


def search(logs: DataFrame, where: Column, size: int = 5000, newest: bool = True) -> DataFrame:
    """The first size matches by time, ties by log_id; size from 1 to 10000."""
    order = [F.desc("ts"), F.desc("log_id")] if newest else ["ts", "log_id"]
    return logs.where(where).orderBy(*order).limit(min(max(size, 1), 10_000))


def terms(logs: DataFrame, c: Column, most: int, missing: str | None = None) -> DataFrame:
    """The most frequent values of a field, ties by value; nulls count under missing if it is given, else not at all."""
    value = F.coalesce(c.cast("string"), F.lit(missing)) if missing is not None else c.cast("string")
    return logs.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def learned_signals(signals: DataFrame, least: float = 0.7, most: int = 200) -> DataFrame:
    """The most used learned signals that are sure enough and not among the fixed ones."""
    known = signals.sparkSession.createDataFrame([(s,) for s in V.STATIC_SIGNALS], "signal string")
    return signals.where(F.col("confidence") >= least).join(F.broadcast(known), "signal", "left_anti").orderBy(F.desc("hits"), "signal").limit(most)
