"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The words of each source form one stream: its documents in an order shuffled by md5(seed, doc_id). The stream is
cut into blocks of equal length. Slot k of the mix gets the point k * g mod 2^31 (g: 2^31 / golden ratio), which
the cumulative target shares map to a source; the r-th slot of a source takes block r of its stream, which starts
anew at its end. So any stretch of slots holds the sources near their shares, and reruns agree.

Nulls, ties, empty inputs: a null text has size 0 and is never taken; a null source is a source of its own, the
last; rows that repeat are further documents (taken each on its own); equal doc_ids are ordered by size; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.shared import BLANKS, small, stash

POINTS = 1 << 31
#: The odd integer next to 2^31 / golden ratio.
STEP = 1327217885
BINS = 4096


def sized(docs: DataFrame, seed: str) -> DataFrame:
    words = F.size(F.array_remove(F.split("text", BLANKS), ""))
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("key"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("ord"))


def targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3) -> DataFrame:
    """docs (source, size) -> src, source, source_size, weight, target: shares of all words by weight, each at most most_repeats times its source's words.

    The excess of capped sources goes to the others by weight until none is above: with the sources in order of
    cap / weight, those before the first one that the rest's level doesn't fill are capped.
    """
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size").cast("double") * most_repeats).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", "src")
    everything, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "src", "level"))).over(everything)
    by = by.withColumn("level", first["level"])
    return by.select("src", "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """shares (src, target) -> slot, src, rank: the slots in order, each with its source and its rank among the source's slots."""
    spark = shares.sparkSession
    total = F.nullif(F.sum("target").over(Window.partitionBy()), F.lit(0.0))
    upto = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    ends = shares.select("src", F.round((upto - F.col("target")) / total * POINTS).cast("long").alias("low"), F.round(upto / total * POINTS).cast("long").alias("high")).where("high > low")
    width = POINTS // BINS
    bins = ends.select("*", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("bin"))
    bins = small(stash(bins, "mix-bins"), 200_000)
    run = max(1024, math.isqrt(slots))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("x"))
    drawn = points.withColumn("bin", F.floor(F.col("x") / width)).join(bins, "bin").where("x >= low and x < high").select("slot", "src", F.floor(F.col("slot") / run).alias("run"))
    counts = drawn.groupBy("src", "run").agg(F.count("*").alias("n"))
    before = counts.select("src", "run", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = drawn.withColumn("own", F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1)
    return own.join(before, ["src", "run"]).select("slot", "src", (F.col("before") + F.col("own")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_repeats: int = 3, block_words: int = 64, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, source) -> pieces and documents.

    pieces: slot, src, block, doc_id, start, size, pass, from_word, n_words: which words of which document a slot of the
    mix holds, in its pass-th run through the source. documents: doc_id, source, key (of its doc_id and text), size, source_size, target, start of each row.
    Sources are ranked and their excess is shared in one task, over one row for each source: some millions of sources at most.
    """
    rows = sized(docs, seed)
    shares = stash(targets(rows, weights, most_repeats), "mix-shares")
    n, words = docs.count(), shares.agg(F.sum("target")).first()[0] or 0
    near = small(shares.select("src", F.col("source").alias("own_source"), "source_size", "target"), 100_000)
    buckets = max(16, math.isqrt(n))
    rows = rows.join(near, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    rows = stash(rows, "mix-rows")
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("src", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("src", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inner)).join(before, ["src", "bucket"])
    placed = stash(placed.select("doc_id", "source", "key", "src", "size", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("start")), "mix-placed")
    slots = stash(schedule(shares, math.ceil(words / block_words)), "mix-slots")
    taken = small(stash(slots.groupBy("src").agg((F.count("*") * block_words).alias("words")), "mix-taken"), 100_000)
    reach = placed.where("size > 0").join(taken, "src").withColumn("words", F.least("words", F.col("source_size") * most_repeats))
    each = reach.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")))).alias("pass"))
    each = each.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start")).where("at < words").withColumn("end", F.least(F.col("at") + F.col("size"), F.col("words")))
    blocks = each.select("*", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"))
    low, high = F.greatest("at", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = blocks.join(slots.withColumnRenamed("rank", "block"), ["src", "block"]).select("slot", "src", "block", "doc_id", "start", "size", "pass", (low - F.col("at")).alias("from_word"), (high - low).alias("n_words"))
    return pieces, placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    pieces, placed = mix(docs, **options)
    sums = pieces.groupBy("src", "start").agg(F.sum("n_words").alias("taken"))
    used = placed.where("size > 0").join(sums, ["src", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return used.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in slot order: slot, part (of the slot), source, doc_id, pass, from_word, n_words, text, where text is those words, one blank between.

    A text meets the list of each of its rows' pieces, which is as long as the row, and is cut where it lies; where rows repeat, Spark can split the join.
    """
    pieces, placed = mix(docs, **options)
    names = placed.where("size > 0").select("src", "start", "key", "source")
    own = F.struct("slot", "source", F.col("src"), "block", "start", "pass", "from_word", "n_words")
    wanted = pieces.join(names, ["src", "start"]).groupBy("key", "src", "start").agg(F.collect_list(own).alias("own"))
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").dropDuplicates(["key"])
    # words before the join: Spark would else put their making into the cut, once for each piece
    words = texts.select("doc_id", "key", F.array_remove(F.split("text", BLANKS), "").alias("words")).join(wanted.select("key", "own"), "key")
    cut = F.transform("own", lambda p: F.struct(*[p[c].alias(c) for c in ("slot", "source", "src", "block", "start", "pass", "from_word", "n_words")], F.array_join(F.slice("words", (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), " ").alias("text")))
    rows = words.select("doc_id", cut.alias("cut")).select("doc_id", F.explode_outer("cut").alias("p"))
    rows = rows.select("p.slot", F.struct("p.pass", "p.start").alias("part"), "p.source", "doc_id", "p.pass", "p.from_word", "p.n_words", "p.text")
    return rows.repartitionByRange("slot", "part").sortWithinPartitions("slot", "part")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same mix in DuckDB: the streams by running sums, the schedule from all its points.
OP8_SQL = r"""
with rows_ as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as ord from documents),
by_ as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as src from rows_ group by source),
w_ as (select *, [5.0, 2.0, 1.0][(src % 3 + 1)::int]::double as weight, 3.0::double * source_size as cap from by_),
l_ as (select *, cap / weight as fills_at, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level0
       from w_ window o as (order by cap / weight, src rows between unbounded preceding and 1 preceding)),
t_ as (select src, source, source_size, least(cap, coalesce((select level0 from l_ where level0 <= fills_at order by fills_at, src limit 1) * weight, cap)) as target from l_),
e_ as (select *, round((sum(target) over (order by src) - target) / sum(target) over () * 2147483648)::bigint as low, round(sum(target) over (order by src) / sum(target) over () * 2147483648)::bigint as high from t_),
p_ as (select (k % 2147483648) * 1327217885 % 2147483648 as x from range((select ceil(sum(target) / 64)::bigint from t_)) r(k)),
n_ as (select src, count(*) * 64 as words from p_ join e_ on x >= low and x < high group by src),
s_ as (select r.doc_id, r.size, t.source_size, t.target, least(coalesce(n.words, 0), 3 * t.source_size) as words,
       (sum(r.size) over (partition by t.src order by ord, doc_id, r.size rows between unbounded preceding and current row) - r.size)::bigint as start
       from rows_ r join t_ t on r.source is not distinct from t.source left join n_ n on n.src = t.src)
select doc_id, size, source_size, target, case when source_size = 0 then 0 else size * (words // source_size) + greatest(0, least(start + size, words % source_size) - start) end::bigint as taken from s_
"""
