"""Stack merging, keep-first, fingerprints against a seen set, comparison of result sets, keyed upserts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import text as X
from quarrylog.functions import values as V


def merge_stacks(lines: DataFrame, *keys: str) -> DataFrame:
    """lines (keys, seq, line): continuation lines join the line before that isn't one; seq is the first line's."""
    order = Window.partitionBy(*keys).orderBy("seq")
    parent = (~X.is_stack_line(F.col("line"))).cast("int")
    islands = lines.withColumn("island", F.sum(parent).over(order))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n")
    return islands.groupBy(*keys, "island").agg(F.min("seq").alias("seq"), F.count("*").alias("n_lines"), merged.alias("message")).drop("island")


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key. A minimum per key, so that a hot key is reduced before the shuffle."""
    payload = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(key.alias("dedup_key")).agg(F.min(payload).alias("r"), F.count("*").alias("copies")).select("dedup_key", "copies", "r.*")


def unseen(rows: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """rows whose fingerprint isn't in seen (fingerprint, expire_at), or only in entries that have expired."""
    return rows.join(seen.where(F.col("expire_at") > F.lit(as_of)).select("fingerprint").distinct(), "fingerprint", "left_anti")


def remember(seen: DataFrame, rows: DataFrame, as_of, seconds: int) -> DataFrame:
    """The next snapshot of seen (fingerprint, expire_at): the fingerprints of rows live so long from now, and what has expired goes."""
    until = (F.lit(as_of) + F.make_dt_interval(secs=F.lit(seconds))).cast("timestamp_ntz")
    both = seen.select("fingerprint", "expire_at").unionByName(rows.select("fingerprint", until.alias("expire_at")))
    return both.where(F.col("fingerprint").isNotNull() & (F.col("expire_at") > F.lit(as_of))).groupBy("fingerprint").agg(F.max("expire_at").alias("expire_at"))


def write_back(analyses: DataFrame, as_of, ttl_hours: int = 168, most: int = 3000) -> DataFrame:
    """analyses (content, ...) as new rows of the known issues, to be appended: open, seen once, with a time to live; content is cut."""
    now, none = F.lit(as_of).cast("timestamp_ntz"), F.lit(None)
    fresh = {
        "content": F.substring("content", 1, most), "status": F.lit("open"), "hits": F.lit(1).cast("long"), "created_at": now, "first_seen": now, "last_seen": now,
        "expire_at": now + F.make_dt_interval(hours=F.lit(ttl_hours)), "resolved_at": none.cast("timestamp_ntz"), "quality": none.cast("string"),
    }
    return analyses.withColumns(fresh)


def compare(base: DataFrame, other: DataFrame, band: float = 0.15) -> DataFrame:
    """base and other (signature, severity, confidence, seq), the last of a signature counting -> signature and how it changed.

    Severity decides first, then a confidence that differs by more than the band.
    """
    last = lambda df: df.where("signature <> ''").groupBy("signature").agg(F.max(F.struct("seq", "severity", "confidence")).alias("r"))
    both = last(base).withColumnRenamed("r", "a").join(last(other).withColumnRenamed("r", "b"), "signature", "full_outer")
    rank = lambda c: X.lookup(c, V.SEVERITY_RANK, 0)
    up, more = rank(F.col("b.severity")) - rank(F.col("a.severity")), F.round(F.col("b.confidence") - F.col("a.confidence"), 9)
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").when(up > 0, "worsened").when(up < 0, "improved").when(more > band, "worsened").when(more < -band, "improved").otherwise("unchanged")
    return both.select("signature", change.alias("change"), F.col("a.severity").alias("before"), F.col("b.severity").alias("after"))


def upsert_signals(old: DataFrame, seen: DataFrame, least_length: int = 3) -> DataFrame:
    """old (id, signal, confidence, hits, first_seen, last_seen) with seen (signal, confidence, ts) added: hits add up, the largest confidence and the ends of time stay.

    The result is a new snapshot: Parquet has no row updates, and a path isn't written while it is read.
    """
    new = seen.where((F.char_length("signal") >= least_length) & ~F.col("signal").isin(*V.STATIC_SIGNALS))
    new = new.select(F.md5("signal").alias("id"), "signal", "confidence", F.lit(1).cast("long").alias("hits"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"))
    return old.unionByName(new).groupBy("id", "signal").agg(F.max("confidence").alias("confidence"), F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def upsert_rules(old: DataFrame, seen: DataFrame) -> DataFrame:
    """As for signals, for rules (line_id, rule, confidence, ts) of 10 characters or more, keyed by line and rule."""
    new = seen.where(F.char_length("rule") >= 10)
    new = new.select(F.md5(F.concat_ws(":", "line_id", "rule")).alias("id"), "line_id", "rule", "confidence", F.lit(1).cast("long").alias("hits"), F.col("ts").alias("last_seen"))
    return old.unionByName(new).groupBy("id", "line_id", "rule").agg(F.max("confidence").alias("confidence"), F.sum("hits").alias("hits"), F.max("last_seen").alias("last_seen"))


def halve(signals: DataFrame, blamed: DataFrame, least: float = 0.3) -> DataFrame:
    """Signals that feedback blames lose half their confidence and go below the least."""
    marked = signals.join(blamed.select("id", F.lit(True).alias("blamed")).distinct(), "id", "left")
    return marked.withColumn("confidence", F.when(F.col("blamed"), F.col("confidence") / 2).otherwise(F.col("confidence"))).where(F.col("confidence") >= least).drop("blamed")


def retain(parents: DataFrame, children: DataFrame, key: str, since) -> tuple[DataFrame, DataFrame]:
    """Parents created since, and the children whose parents stay."""
    kept = parents.where(F.col("created_at") >= F.lit(since))
    return kept, children.join(kept.select(key), key, "left_semi")


def hit_issues(issues: DataFrame, hits: DataFrame, ttl_hours: int = 168) -> DataFrame:
    """issues (id, hits, last_seen, expire_at, ...) with hits (id, ts) counted in and their time to live renewed."""
    new = hits.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("at"))
    out = issues.join(new, "id", "left")
    cols = {"hits": F.coalesce("hits", F.lit(0)) + F.coalesce("n", F.lit(0)), "last_seen": F.coalesce("at", "last_seen"), "expire_at": F.coalesce(F.col("at") + F.make_dt_interval(hours=F.lit(ttl_hours)), F.col("expire_at"))}
    return out.withColumns(cols).drop("n", "at")


def set_status(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """issues with updates (id, to, at): resolved sets a time, open clears it; ignored is poor quality until it is undone; verified lives a year longer."""
    out = issues.join(updates, "id", "left")
    to = F.col("to")
    cols = {
        "resolved_at": F.when(to == "resolved", F.col("at")).when(to == "open", None).otherwise(F.col("resolved_at")),
        "quality": F.when(to == "ignored", "poor").when(to.isNotNull() & (F.col("status") == "ignored"), None).otherwise(F.col("quality")),
        "expire_at": F.when(to == "verified", F.col("at") + F.make_dt_interval(days=F.lit(365))).otherwise(F.col("expire_at")),
        "status": F.when(to.isin("resolved", "open", "ignored"), to).otherwise(F.col("status")),
    }
    return out.withColumns(cols).drop("to", "at")
