"""What several operators use: checked broadcasts, word columns and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylog.sources.scratch import delete, scratch, stash  # noqa: F401  # the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to Python are cut by bytes too, so that a run of very long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def spot(names: list[str], name: str) -> int:
    """Which of the columns Spark takes for a name: the one written so, else in other case."""
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def packed(names: list[str]) -> tuple[Column, list[Column]]:
    """One struct column "own" of so many columns, and the columns that take it apart again; so their names clash with none of an operator's."""
    fields = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(names)]
    return F.struct(F.lit(0).alias("c"), *fields).alias("own"), [F.col(f"own.c{i}").alias(c) for i, c in enumerate(names)]


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a shuffled join. Give it a stashed or cheap df: it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(c: Column) -> Column:
    """Only A-Z become a-z; ASCII texts, the usual case, take the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def alnum_words(c: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(c), NOT_ALNUM), ""), F.array().cast("array<string>"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then follows the label's own label, so paths
    shorten by halves. Only minima and equi-joins are used: no task gathers the neighbours of a node.
    Raises if so many rounds, enough for paths of 2 ** rounds nodes, don't end it.
    """
    both = stash(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    label = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("r"))
        label = stash(lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("r", "root")).alias("root")), "labels")
        changed = label.where("was <> root").limit(1).count()
        label = label.select("node", "root")
        if not changed:
            return label
    raise RuntimeError(f"connected components did not settle in {rounds} rounds")


def labelled_sample(rows: DataFrame, label: str, each: int, most: int, by: str) -> DataFrame:
    """About each distinct rows of every label for fitting, fewer where there are so many labels that it would be over most in all, one at least; the same rows in every run.

    A row is taken if a hash of its column by falls under its label's share, which comes from an estimate (by 2 % or so) of the label's distinct
    values, however often each is repeated; of what falls under it, those of the smallest hashes, so that no label has more. The value of the
    smallest hash is always taken.
    """
    at = F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    counts = stash(rows.groupBy(label).agg(F.approx_count_distinct(at, 0.02).alias("_of"), F.min(at).alias("_least")), "label-counts")
    each = max(1, min(each, most // max(1, counts.count())))
    taken = (F.col("_at") < F.lit(1.3 * each + 8) / F.col("_of")) | (F.col("_at") <= F.col("_least"))
    drawn = rows.join(small(counts, 10_000), label).withColumn("_at", at).where(taken).drop("_of", "_least").distinct()
    return drawn.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_at", by))).where(F.col("_rank") <= each).drop("_at", "_rank")
