"""Periodic runs against a search through all periods, on random texts, odd rows and the given documents."""

import fractions
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quarrylog.llm import word_runs

SF = "/root/testdata/sf0.001"


def all_runs(w, least=24, repeats=3):
    """Every period's longest stretches; of one stretch its smallest period."""
    out = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def asked(doc_id, text):
    w = [] if text is None else text.encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def row(doc_id, text):
    w = asked(doc_id, text)
    found = all_runs(w)
    top = min(found, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(1500):
        least, texts = rng.choice([1, 3, 6, 24]), []
        for _ in range(rng.randint(0, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))]
            unit = [rng.randrange(3) for _ in range(rng.randint(1, 8))]
            at = rng.randint(0, len(w))
            texts.append([b"%d" % x for x in w[:at] + (unit * 12)[: rng.randint(0, 90)] + w[at:]])
        assert word_runs.runs_of_texts(texts, least, 3) == [all_runs(t, least) for t in texts]


def test_long_runs_end():
    assert word_runs.runs_of_texts([[b"x"] * 100_000], 24, 3) == [[(0, 100_000, 1)]]
    assert word_runs.runs_of_texts([[b"%d" % (i % 5) for i in range(100_001)]], 24, 3) == [[(0, 100_001, 5)]]
    nested = ([b"a"] * 30 + [b"b"]) * 4
    assert word_runs.runs_of_texts([nested], 24, 3) == [all_runs(nested)]


def test_query_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(tuple(r) for r in word_runs.op13_word_runs(spark, SF).select(*names).collect())
    want = sorted(row(*r) for r in docs)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows_and_other_columns(spark):
    """Nulls, blanks, repeats, a long text, words of any bytes; columns of the operator's own names keep their values or are replaced as stated."""
    many = " ".join(f"w{i}" for i in range(60_000)) + " x y" * 30
    rows = [(None, None, "k", 1), (1, None, None, 2), (2, "", "k", 3), (3, " \t\n\x0b\x0c\r ", "k", 4), (4, "é é " * 40, "k", 5), (4, "é é " * 40, "k", 5), (5, many, "k", 6), (6, "a\x00 " * 24, "k", 7), (7, "a " * 23, "k", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, runs int").withColumn("c0", F.col("own"))
    out = word_runs.find_runs(docs, F.col("text"))
    assert out.columns == ["doc_id", "text", "own", "c0", "n_words", "runs", "collapsed"]
    got = sorted(out.collect(), key=repr)
    for r in got:
        w = [] if r["text"] is None else r["text"].encode().split()
        found = [tuple(x) for x in r["runs"]]
        assert found == ([(60_000, 60, 2)] if r["doc_id"] == 5 else all_runs(w))
        assert (r["n_words"], r["c0"]) == (len(w), r["own"])
    assert sorted(r["collapsed"] for r in got if r["doc_id"] in (4, 6)) == ["a\x00", "é é", "é é"]
    assert word_runs.find_runs(docs.where("false"), F.col("text")).count() == 0
