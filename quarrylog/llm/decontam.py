"""Benchmark decontamination: a broadcast hash set of test n-grams against the word windows of whole texts.

Each item gives its windows of n words (an item of fewer words, but some, gives one window). Their hashes are
broadcast if their number is within a checked bound, else joined by a shuffle. A text's windows are hashed in one
scan, looked up, and a hit counts only if the words are equal. Hit windows are merged to hit words and spans.

Nulls, ties, empty inputs: null or wordless texts have no words and no hits; null or wordless items have no
windows; repeated rows are judged alike, each by its own text; an item_id that repeats counts once; null item_ids are
not listed; empty tables give an empty result or no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.shared import alnum_words, packed, small, stash


def starts(words: Column, n: int) -> Column:
    """The places from which n words follow; none if there are fewer."""
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def test_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, n (words), words, hash of each distinct window of the items."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("w")).where("size(w) > 0")
    each = F.transform(starts(F.col("w"), n), lambda i: F.slice("w", i + 1, n))
    rows = items.select("item_id", F.explode(F.when(F.size("w") < n, F.array("w")).otherwise(each)).alias("words")).distinct()
    return rows.select("item_id", F.size("words").alias("n"), "words", F.xxhash64("words").alias("hash"))


def hits(docs: DataFrame, tests: DataFrame, n: int = 10, most_broadcast: int = 2_000_000) -> DataFrame:
    """docs (key, words) and stashed tests -> key, at, n, hash, test of each occurrence of a test window.

    A text is scanned once: the windows of all lengths that tests have (n, and fewer words of short items) are hashed together, and
    only key and hash go on, so that a very long text isn't copied for each of its windows. Of the tests only the hashes are broadcast, 8 bytes
    each; beyond most_broadcast of them the join is shuffled. The words of texts with hits are then fetched once, and a hit counts if they are equal.
    """
    known = small(tests.select("hash").distinct(), most_broadcast)
    lengths = sorted(r["n"] for r in tests.select("n").distinct().collect()) or [n]
    of = lambda k: F.transform(starts(F.col("words"), k), lambda i: F.xxhash64(F.slice("words", i + 1, k)))
    hashes = [of(k) for k in lengths]
    # the hashes are a column before they are exploded, so that the words stay behind; an outer explode, as Spark would otherwise
    # filter by the array's size before, and cut the text into words anew for each window there
    scanned = docs.select("key", F.size("words").alias("m"), (F.flatten(F.array(*hashes)) if len(hashes) > 1 else hashes[0]).alias("hashes"))
    found = scanned.select("key", "m", F.posexplode_outer("hashes").alias("pos", "hash")).join(known, "hash")
    # the windows of one length stand behind those of the shorter ones
    before = [F.lit(0)]
    for k in lengths:
        before.append(before[-1] + F.greatest(F.col("m") - k + 1, F.lit(0)))
    at, long = F.col("pos") - before[-2], F.lit(lengths[-1])
    for i in reversed(range(len(lengths) - 1)):
        inside = F.col("pos") < before[i + 1]
        at, long = F.when(inside, F.col("pos") - before[i]).otherwise(at), F.when(inside, F.lit(lengths[i])).otherwise(long)
    found = stash(found.select("key", at.alias("at"), long.alias("n"), "hash").distinct(), "window-hits")
    spots = found.groupBy("key").agg(F.collect_list(F.struct("at", "n", "hash")).alias("spots"))
    if found.limit(most_broadcast + 1).count() <= most_broadcast:
        spots = F.broadcast(spots)
    own = F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["hash"].alias("hash"), F.slice("words", s["at"] + 1, s["n"]).alias("own")))
    there = docs.join(spots, "key").select("key", own.alias("own")).select("key", F.explode_outer("own").alias("s")).select("key", "s.*").distinct()
    texts = tests.select("n", "hash", F.col("words").alias("test")).distinct()
    return there.join(small(texts, 200_000), ["n", "hash"]).where("own = test").select("key", "at", "n", "hash", "test")


def merged(found: DataFrame) -> DataFrame:
    """found (key, at, n) -> key, spans, n_hit: the runs that overlapping or touching windows make, by a running maximum over sorted starts."""
    order = Window.partitionBy("key").orderBy("at", "end")
    runs = found.select("key", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    runs = runs.withColumn("upto", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("at") <= F.col("upto"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"), F.sum(F.col("end") - F.col("at")).cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_broadcast: int = 2_000_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, n_words, n_hit, items, spans (first and end word of each merged run)."""
    key = F.xxhash64(F.coalesce(F.md5("text"), F.lit("")), "doc_id")
    # a text goes with its row here only to be cut into words; what is shuffled are keys, counts and hits
    rows = docs.select("doc_id", key.alias("key"), alnum_words(F.col("text")).alias("words"))
    tests = stash(test_windows(benchmark, n), "test-windows")
    found = stash(hits(rows, tests, n, most_broadcast), "hits")
    listed = found.select("key", "n", "hash", "test").distinct().join(tests.select("n", "hash", F.col("words").alias("test"), "item_id"), ["n", "hash", "test"])
    items = listed.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    judged = merged(found).join(items, "key", "left")
    out = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(judged, "key", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_hit: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose share of hit words is at most most_hit."""
    key = F.xxhash64(F.coalesce(F.md5("text"), F.lit("")), "doc_id")
    judged = decontaminate(docs, benchmark, n).where(F.col("n_hit") > F.col("n_words") * most_hit).select(F.col("key").alias("_hit")).distinct()
    own, columns = packed(docs.columns)
    return docs.select(key.alias("_key"), own).join(small(stash(judged, "contaminated"), 1_000_000), F.col("_key") == F.col("_hit"), "left_anti").select(*columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text with each hit span, from its first word to its last, cut out."""
    key = F.xxhash64(F.coalesce(F.md5("text"), F.lit("")), "doc_id")
    spans = decontaminate(docs, benchmark, n).where("n_hit > 0").select(F.col("key").alias("_hit"), "spans").dropDuplicates(["_hit"])
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("text", F.lit(f"{word}|{gap}"), F.lit(0))
    first = F.when(F.col("text").rlike(f"^{gap}"), 1).otherwise(0)  # pieces alternate: word i is piece 2 i, after a leading gap 2 i + 1
    inside = lambda i: F.exists("spans", lambda s: (i >= s["at"] * 2 + first) & (i <= (s["end"] - 1) * 2 + first))
    cut = F.array_join(F.transform(F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~inside(x["i"])), lambda x: x["p"]), "")
    return docs.select("doc_id", "text", key.alias("_key")).join(spans, F.col("_key") == F.col("_hit"), "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias("text"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+'), []::varchar[]) as w, row_number() over () as k from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from benchmark),
t as (select distinct item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g, least(10, len(w)) as n from (select *, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
l as (select distinct n from t),
p as (select k, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, l)),
h as (select distinct k, i, p.n, item_id from p join t on p.n = t.n and p.g = t.g),
c as (select k, count(*) as n_hit from (select distinct k, unnest(range(i, i + n)) as j from h) group by k),
m as (select k, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct k, item_id::varchar as x from h) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (k) left join m using (k)
"""
