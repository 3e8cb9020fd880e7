"""Chat formatting by quotation linking: conversations in reply order, without their quotes.

A message's lines are parsed for nested quote marks. Quoted passages, and single quoted lines, are normalised and hashed
and joined to the own passages and lines of earlier messages of the same conversation; the message that most of the
outermost quote stands in is the one replied to. Following replies gives each message its root and its depth.

Only conversations that hold quotes are searched. A passage that many messages repeat is linked to the
latest earlier one, found by running maxima in two steps, so that no message is paired with all that repeat a line.

Nulls, ties, empty inputs: a null text is empty; messages without conv_id or turn reply to nothing; of equally good
messages the latest is replied to; rows that repeat a conv_id and turn are messages of the same place; a message without
quotes, or whose quotes are found nowhere, starts a thread; an empty table gives an empty result. Other columns are ignored.
Assembled, a conversation in which no reply was found is one thread by its turns, and a message without conv_id or turn stands alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.shared import bounded_batches, small, stash

MARKS = re.compile(r"^\s*((?:>\s?)+)")
WROTE = re.compile(r"^.*\b(wrote|schrieb|a écrit|escribió)\s*:\s*$", re.I)
#: Turns of a conversation that one task looks back over.
RUN = 512
#: Rows of one place in a conversation, its turn given more than once, that still stand among the others of its thread.
REPEATS = 16
PARSED = "own string, quotes int, units array<struct<level:int,hash:long,length:int>>"


def parse(text: str | None) -> tuple[str, int, list[tuple[int, int, int]]]:
    """The own text without quotes and their introductions, the number of quoted lines, and level, hash and length of passages and lines; own ones have level 0."""
    lines = []
    for line in (text or "").splitlines():
        m = MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    keep = [line for i, (level, line) in enumerate(lines) if not level and not (WROTE.match(line) and i + 1 < len(lines) and lines[i + 1][0])]
    units, run = set(), []

    def add(level: int, words: list[str]) -> None:
        if words:
            joined = " ".join(words)
            units.add((level, xxhash.xxh3_64_intdigest(joined) - (1 << 63), len(joined)))

    last = None
    for level, line in [*lines, (-1, "")]:
        words = re.findall(r"\w+", line.lower())
        if level != last or not words:
            add(last or 0, [w for r in run for w in r])
            run = []
        add(max(level, 0), words)
        run.append(words)
        last = level
    return "\n".join(keep).strip(), sum(level > 0 for level, _ in lines), sorted(units)


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> conv_id, turn, role, own, quotes, units."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(t) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["own"], out["quotes"] = [r[0] for r in rows], [r[1] for r in rows]
            out["units"] = [[{"level": a, "hash": b, "length": c} for a, b, c in r[2]] for r in rows]
            yield out

    bounded_batches(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInPandas(each, f"conv_id long, turn long, role string, {PARSED}")


def quoted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent: for each message with quotes that are found, the message it replies to."""
    talks = small(stash(rows.where("quotes > 0 and conv_id is not null and turn is not null").select("conv_id").distinct(), "quoting"), 200_000)
    units = rows.where("turn is not null").join(talks, "conv_id", "left_semi").select("conv_id", "turn", "quotes", F.explode("units").alias("u")).select("conv_id", "turn", "u.level", "u.hash", "u.length")
    units = stash(units.distinct(), "units").withColumn("run", F.floor(F.col("turn") / RUN))
    key = ["conv_id", "hash"]
    latest = F.max(F.when(F.col("level") == 0, F.col("turn")))
    runs = units.groupBy(*key, "run").agg(latest.alias("own"))
    runs = runs.select(*key, "run", F.max("own").over(Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = latest.over(Window.partitionBy(*key, "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = units.withColumn("inside", inside).where("level > 0").join(runs, [*key, "run"]).withColumn("parent", F.coalesce("inside", "before")).where("parent is not null")
    sums = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("length").alias("length"))
    return sums.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "length", "parent"))["parent"].alias("parent"))


def threads(links: DataFrame, rounds: int = 40) -> DataFrame:
    """conv_id, turn, parent -> with root and depth, by doubling the steps that each message looks up in a round."""
    up = stash(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(rounds):
        over = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        joined = up.join(over, ["conv_id", "root"], "left")
        if not joined.where("further is not null").limit(1).count():
            return up
        up = stash(joined.select("conv_id", "turn", "parent", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    raise RuntimeError(f"threads are deeper than 2 ** {rounds}")


def conversations(messages: DataFrame) -> DataFrame:
    """messages -> conv_id, root, turn, role, text (without quotes), parent, depth, n_quoted: sort by conv_id, root, turn for reply order."""
    rows = stash(parsed(messages), "messages")
    links = quoted(rows)
    where = small(threads(links), 200_000)
    out = rows.drop("units").join(where, ["conv_id", "turn"], "left")
    return out.select("conv_id", F.coalesce("root", "turn").alias("root"), "turn", "role", F.col("own").alias("text"), "parent", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("quotes").alias("n_quoted"))


def assembled(told: DataFrame) -> DataFrame:
    """What conversations gives -> conv_id, root, first_turn, last_turn, messages: each thread's messages in reply order, an array of turn, role, text, parent.

    A message comes after the one it replies to. A thread comes in pieces of RUN turns, so that no task holds a whole long conversation: sort by conv_id,
    root, first_turn. Of a place with more than REPEATS rows, the rows come in pieces of their own, of about RUN each.
    """
    rows = stash(told, "told").withColumn("row", F.monotonically_increasing_id())
    placed = rows.where("conv_id is not null and turn is not null")
    talks = small(stash(placed.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max(F.col("parent").isNotNull()).alias("linked")), "talks"), 200_000)
    places = small(stash(placed.groupBy("conv_id", "turn").agg(F.count("*").alias("of")).where(F.col("of") > REPEATS), "places"), 200_000)
    placed = placed.join(talks, "conv_id").withColumn("root", F.when(F.col("linked"), F.col("root")).otherwise(F.col("first"))).join(places, ["conv_id", "turn"], "left")
    own = F.when(F.col("of").isNotNull(), F.struct("turn", F.pmod(F.col("row"), F.ceil(F.col("of") / RUN)).alias("slot")))
    message = F.struct("turn", "role", "text", "parent")
    pieces = placed.groupBy("conv_id", "root", F.floor(F.col("turn") / RUN).alias("run"), own.alias("own")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_list(message)).alias("messages"))
    alone = rows.where("conv_id is null or turn is null").select("conv_id", "root", F.col("turn").alias("first_turn"), F.col("turn").alias("last_turn"), F.array(message).alias("messages"))
    return pieces.select(*alone.columns).union(alone)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
