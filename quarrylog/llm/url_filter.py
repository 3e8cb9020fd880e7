"""URL filters: fixed host and path rules, and association rules that FP-growth mines from labelled pages.

A url becomes a set of tokens (host suffixes, words of host and path, file ending, query keys, scheme). Pages with a known
verdict, by a fixed rule or by labels, are the transactions, with one item more for bad ones. Rules "tokens -> bad" over the limits of
support, confidence and lift form an inverted index: each is posted under its rarest token, a url looks up its own tokens, and what it
finds is verified by containment. All of it is DataFrame operations and Spark's own FP-growth.

Nulls, ties, empty inputs: a null url or one without "://" has empty host and path, no tokens, no rule and the
verdict allow; of fitting fixed rules the longest wins, then the first given; of mined rules the most confident, then the
best supported, then the first by text; without labelled pages or rules nothing is blocked by the method; rows
that repeat are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.shared import UPPER, small, stash

#: host/path and what it says.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD = "label:bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: its host's suffixes, the words of its host's labels and of its path, file ending, query keys, fragment, scheme.

    Runs of digits are one mark, and words of nothing else are left out.
    """
    worded = lambda kind, c, cut: F.transform(F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]+", "#"), cut), lambda w: ~w.isin("", "#")), lambda w: F.concat(F.lit(kind), w))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ending = F.regexp_extract(F.lower(path), r"\.([a-z0-9]{1,5})$", 1)
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda k: F.concat(F.lit("query:"), k))
    rest = F.filter(F.array(F.when(ending != "", F.concat(F.lit("ending:"), ending)), F.when(url.contains("#"), F.lit("fragment")), F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))), lambda t: t.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, worded("word:", host, r"[.\-_]"), worded("path:", path, "/"), keys, rest)))


def one_of_each(labelled: DataFrame) -> DataFrame:
    """labelled (row, tokens, bad) -> row, token, bad without tokens that are always together with another: the first of such tokens stands for all.

    Sets of them would be as many as their subsets, and say nothing more. Tokens are together if they stand in as many rows, with
    the same sums of the rows' hashes.
    """
    rows = labelled.select("row", "bad", F.explode_outer("tokens").alias("token")).where("token is not null")
    sums = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    first = stash(sums.groupBy("n", "s", "t").agg(F.min("token").alias("token")), "url-tokens")
    return rows.join(small(first.select("token"), 1_000_000), "token", "left_semi")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2, min_rows: int = 10) -> DataFrame:
    """labelled (tokens, bad) -> rule, tokens, confidence, support, lift, rare: the association rules that say bad.

    FP-growth over all labelled rows; min_support bounds the number of items and so of rules. Rules that hold in
    fewer than min_rows rows, that say little more than the share of bad rows does, whose tokens always come with another rule's
    further token, or whose confidence a rule on fewer tokens reaches, are pruned.
    """
    from pyspark.ml.fpm import FPGrowth

    labelled = stash(labelled.where("size(tokens) > 0").withColumn("row", F.monotonically_increasing_id()), "url-rows")
    n = labelled.count()
    if n < max(1, min_rows):
        return labelled.sparkSession.createDataFrame([], "rule string, tokens array<string>, confidence double, support double, lift double, rare string")
    baskets = one_of_each(labelled).groupBy("row").agg(F.collect_set("token").alias("tokens"), F.first("bad").alias("bad"))
    baskets = stash(baskets.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift")
    rules = stash(rules.withColumn("rule", F.array_join("tokens", " ")), "url-rules")
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    each = rules.select("rule", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule").agg(F.min(F.struct("freq", "token"))["token"].alias("rare"))
    rules = stash(rules.join(each, "rule"), "url-rules")

    def within() -> DataFrame:
        """less, more: each rule that another holds all tokens of, with both rules' confidence and number of rows."""
        of = lambda name, *more: [F.col("rule").alias(name), F.col("confidence").alias(f"{name}_sure"), (F.col("support") / F.col("confidence")).alias(f"{name}_rows"), F.col("tokens").alias(f"{name}_tokens"), *more]
        posted = rules.select(*of("more", F.explode("tokens").alias("token")))
        return posted.join(rules.select(*of("less", F.col("rare").alias("token"))), "token").where((F.size("less_tokens") < F.size("more_tokens")) & (F.size(F.array_except("less_tokens", "more_tokens")) == 0))

    open_ = within().where("abs(less_rows - more_rows) < 1e-12 and less_sure <= more_sure + 1e-12").select(F.col("less").alias("rule")).distinct()
    rules = stash(rules.join(open_, "rule", "left_anti"), "url-rules")
    weaker = within().where("less_sure >= more_sure - 1e-12").select(F.col("more").alias("rule")).distinct()
    return rules.join(weaker, "rule", "left_anti")


def judge(pages: DataFrame, rules: DataFrame, fixed: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages (page_id, url) -> page_id, url, host, path, rule, verdict, mined, score: the fixed rule's verdict, else block if a mined rule matches."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    index = small(stash(rules.select("rare", F.col("tokens").alias("needs"), "rule", "confidence", "support"), "url-index"), 100_000)
    seen = rows.where("host <> ''").select("url", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    found = seen.select("url", "tokens", F.explode("tokens").alias("rare")).join(index, "rare").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = found.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule")).alias("best"))
    best = best.select("url", F.col("best.rule").alias("mined"), (-F.col("best.c")).alias("score"))
    rows = rows.join(best, "url", "left").withColumn("fits", fixed_rule(F.col("host"), F.col("path"), fixed))
    return rows.select("page_id", "url", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined", F.coalesce("score", F.lit(0.0)).alias("score"))


def known_pages(pages: DataFrame, labels: DataFrame, fixed: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, tokens, bad of the pages whose verdict is known: a fixed rule gives it, or labels (doc_id, quality, toxic), bad being toxic or of low quality."""
    host, path = host_and_path(F.col("url"))
    bad = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in (F.col("toxic") == 1, F.col("quality") == 0)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("marked"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).join(marks, "page_id", "left")
    ruled = fixed_rule(F.col("host"), F.col("path"), fixed)["verdict"] == "block"
    return rows.select("page_id", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), F.coalesce(ruled, F.col("marked")).alias("bad")).where("bad is not null")


def filter_urls(pages: DataFrame, labels: DataFrame, fixed: tuple[tuple[str, str], ...] = RULES, **limits) -> DataFrame:
    """Mines rules from the pages whose verdict is known, and judges all pages."""
    return judge(pages, mine(known_pages(pages, labels, fixed).select("tokens", "bad"), **limits), fixed)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined", "score")
