"""What samples, stages and mixes must not lose: languages of few distinct windows, values of clashing columns, and rows that repeat."""

import collections

import numpy as np
from pyspark.sql import functions as F

from quarrylog.llm import chat, decontam, langid, mixing, ngram_join, toxicity
from quarrylog.llm.shared import labelled_sample

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "spans", "lang_pred", "_key", "_doc", "_own", "_hit", "own", "c0", "_row", "_seen", "key", "sid", "root")


def test_a_language_of_one_repeated_text_is_learned(spark):
    english = spark.range(3000).select(F.concat(F.lit("the words of row "), F.col("id").cast("string"), F.lit(" are all in plain english here")).alias("text"), F.lit("en").alias("lang"))
    german = spark.range(20_000).select(F.lit("über die straße geht der könig mit großer mühe und schöner krone").alias("text"), F.lit("de").alias("lang"))
    docs = english.unionAll(german).withColumn("doc_id", F.monotonically_increasing_id())
    for each in (40, 400):
        network = langid.train(docs, each=each)
        assert network.languages == ["de", "en"]
    judged = langid.identify(german.limit(1), network).first()
    assert judged["lang_pred"] == "de"


def test_samples_are_of_distinct_values_and_bounded(spark):
    rows = spark.range(50_000).select((F.col("id") % 7).alias("label"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("x"))
    n = {r["label"]: (r["n"], r["d"]) for r in labelled_sample(rows, "label", 100, 10_000, "x").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d")).collect()}
    assert set(n) == set(range(7)) and all(a == d and 90 <= a <= 100 for a, d in n.values())


def test_clashing_columns_keep_their_values(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.unionAll(docs.limit(5)).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in [*pipeline.STAGES[:-1], ("clean", lambda s, d, _: decontam.clean(d, benchmark)), ("copies", lambda s, d, _: ngram_join.without_copies(d))]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHING), name


def test_a_row_repeated_often_is_mixed_piece_by_piece(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three four five").alias("text"), F.lit("a").alias("source"))
    rows = rows.unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source")))
    mixed = mixing.mixed_texts(rows)
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    want = collections.Counter()
    for r in mixing.taken_words(rows).collect():
        want["a" if r["source_size"] == 15_000 else "b"] += r["taken"]
    assert taken == dict(want)
    assert mixed.where(F.size(F.split("text", " ")) != F.col("n_words")).count() == 0


def test_neighbours_of_very_many_words_are_counted_alike():
    """The counts by triples and by numbered neighbours give the same field; the latter is what so many words need that triples overflow."""
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(300)]
    texts = [rng.integers(1, 300, 60).astype(np.int32) for _ in range(80)]
    y = np.array([i % 2 for i in range(80)], float)
    for t in texts[1::2]:
        t[5:7] = 7
    small = toxicity.fit(words, texts, y, passes=1)
    many = toxicity.fit(words + [b"x%d" % i for i in range(2_100_000)], texts, y, passes=1)
    assert small.steps.tolist() == many.steps.tolist() and small.bias == many.bias


def test_introductions_of_any_length_go():
    """Also one of more than 200 characters, which was kept before."""
    text = "On Monday " + "the person of a very long name " * 12 + "wrote:\n> the quoted line\nmy answer"
    assert chat.parse(text)[0] == "my answer"
    assert chat.parse("they wrote:\nno quote follows")[0] == "they wrote:\nno quote follows"
