"""Which texts hold the first characters of which others: an equi-join on anchors, then checked by contains.

Of the grams in each window as long as a prefix, the one of least hash is the window's anchor. A text that holds a prefix has a window equal
to it, so with the same anchor: a prefix gives one anchor, a text those of all its windows, one for some 16 characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.sources.scratch import stash

#: Characters of a prefix, of a gram, so that 32 grams are in a window, and of a text that are hashed at once.
LENGTH, GRAM, PIECE = 80, 49, 1 << 16
FACTOR = 0x9E3779B97F4A7C15


def powers(factor: int) -> np.ndarray:
    """The factor to the powers from 0, modulo 2 ** 64, as many as a piece has characters."""
    return np.cumprod(np.array([1] + [factor] * (PIECE + LENGTH), np.uint64))


def anchors(text: str, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The distinct anchors of the windows of a text; none if it is shorter than a prefix. up and down: powers of FACTOR and of its inverse."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < LENGTH:
        return np.zeros(0, np.int64)
    found = []
    for i in range(0, len(codes) - LENGTH + 1, PIECE):
        own = codes[i : i + PIECE + LENGTH - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])
        # a gram's hash doesn't depend on its place: a difference of sums, over the factor to the power of the place
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(own) - GRAM + 1]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        for step in (1, 2, 4, 8, 16):
            h = np.minimum(h[:-step], h[step:])
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)).view(np.int64)


def anchored(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """texts -> key, anchor of each of the text's anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(FACTOR), powers(pow(FACTOR, -1, 1 << 64))
        for batch in batches:
            at, own, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                own.append(anchors(t.as_py(), up, down))
                at.append(np.full(len(own[-1]), i))
                size += len(own[-1])
                if size > 500_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(own))], [key, "anchor"])
                    at, own, size = [], [], 0

    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return texts.select(key, text.alias("text")).mapInArrow(cut, f"{key} binary, anchor long")


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(texts: DataFrame, key: str, prefixes: DataFrame, broadcast_texts: bool) -> DataFrame:
    """texts (key, text) and prefixes (prefix), distinct -> key, prefix of each that the text holds. The side said to be the smaller is broadcast if it is small."""
    wanted = anchored(prefixes.select(F.encode("prefix", "UTF-8").alias("own"), "prefix"), "own", F.col("prefix")).select(F.decode("own", "UTF-8").alias("prefix"), "anchor")
    there = anchored(texts, key, F.col("text"))
    near = few(there).join(wanted, "anchor") if broadcast_texts else there.join(few(wanted), "anchor")
    # a text goes once to the prefixes it may hold, which are short
    may = stash(near.groupBy(key).agg(F.collect_set("prefix").alias("may")), "may-hold")
    return texts.join(few(may), key).select(key, F.explode(F.filter("may", lambda p: F.col("text").contains(p))).alias("prefix")).distinct()


def matches(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (doc_id, text) and known (item_id, text), the smaller side -> doc_id, item_id of each pair of which one holds the other's prefix.

    Texts and known texts of fewer characters than a prefix match nothing. Repeated texts are judged once, but each row has its matches.
    """
    cut = lambda df, name: df.where(F.char_length("text") >= LENGTH).select("*", F.unhex(F.md5("text")).alias(name), F.substring("text", 1, LENGTH).alias("prefix"))
    d, b = cut(docs, "dk"), cut(known, "bk")
    one = held(d.select("dk", "text"), "dk", b.select("prefix").distinct(), False).join(b.select("bk", "prefix").distinct(), "prefix")
    other = held(b.select("bk", "text"), "bk", d.select("prefix").distinct(), True).join(d.select("dk", "prefix").distinct(), "prefix")
    pairs = stash(one.select("dk", "bk").union(other.select("dk", "bk")).distinct(), "held-pairs")
    return d.select("doc_id", "dk").join(few(pairs), "dk").join(b.select("item_id", "bk"), "bk").select("doc_id", "item_id")
