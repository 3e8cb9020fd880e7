"""Training-data operators against SQL, brute force, round trips and held-out labels, and on nulls, empty tables, ties and repeats."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import chat, decontam, embed_dedup, langid, license_scan, mixing, ngram_join, queries, toxicity, url_filter, warc
from tests.oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, key int, words string, sid string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, rows that repeat, short texts, and other columns whose names the operators use too."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "en", "b"), (2, base, "en", "b"), (2, base, "en", "b"), (3, base.upper(), None, None), (4, None, "en", "a"), (5, "", "en", "a"), (6, "  \n", None, None), (7, "one two", "en", "a"), (8, "ONE  two", "de", "a"), (None, base, "en", "a"), (None, None, None, None), (9, "licensed under the MIT License " + "lorem ipsum dolor sit " * 30_000, "en", "a"), (10, "1234 5678", "en", "a"), (11, "é", "fr", "a")]
    return spark.createDataFrame([(*r, 1, "w", "s", "x") for r in rows], DOCS)


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    for a, b in {(a, b) for ds in held.values() for a in ds for b in ds if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r[0]: (r[1], r[2]) for r in queries.QUERIES["op1_ngram_join"](spark, SF).collect()} == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ngram_join_finds_chains_of_edits(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [list(base)]
    for _ in range(60):
        words = list(texts[rng.integers(len(texts))])
        for at in rng.integers(0, len(words), rng.integers(1, 5)):
            words[at] = f"x{rng.integers(400)}"
        texts.append(words)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(df).collect()}
    assert got == brute_groups(rows)
    sets = {d: shingles(t) for d, t in rows}
    linked = sum(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] != sets[b])
    assert ngram_join.links(df).count() == linked


def test_ngram_join_on_odd_rows(spark, odd):
    rows = ngram_join.near_copies(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == (8, 1)
    assert (by[4], by[5], by[6], by[7], by[8]) == ((0, 4), (0, 5), (0, 6), (1, 7), (1, 7))
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["1", "None"]
    kept = ngram_join.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "9", "10", "11", "None"])
    assert ngram_join.near_copies(empty(odd)).count() == ngram_join.without_copies(empty(odd)).count() == 0


def test_ngram_join_goes_by_texts_not_by_ids(spark):
    """Unlike rows that share a doc_id, rows without one that link, and repeated rows: no document and no link is lost."""
    words = [f"w{i}" for i in range(56)]
    a, b, c = " ".join(words), " ".join(words[5:] + ["x1"]), " ".join(words[10:] + ["x1", "x2", "x3", "x4", "x5"])
    near = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(spark.createDataFrame([(1, a), (None, b), (2, c)], "doc_id long, text string")).collect()}
    assert near == {1: 1, None: 1, 2: 1}
    alone = " ".join(f"y{i}" for i in range(30))
    rows = [(1, b), (5, b), (5, alone), (6, a), (7, alone + " z"), (None, "q r s"), (None, "Q r s"), (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, i // 2) for i, r in enumerate(rows)], "doc_id long, text string, key int")
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.without_copies(docs).collect()), key=repr)
    assert kept == sorted([(1, b), (5, alone), (None, "Q r s") if (None, "Q r s") in kept else (None, "q r s"), (8, ""), (8, ""), (9, None)], key=repr)
    twins = spark.createDataFrame([(3, a, k) for k in (2, 1, 2)], "doc_id long, text string, key int")
    assert [tuple(r) for r in ngram_join.without_copies(twins).collect()] == [(3, a, 1)]


def test_ngram_join_deals_copies_and_common_passages_once(spark):
    """A text that all rows repeat, and a passage that all texts share, bring a row for each batch into a part, not one for each text."""
    long = " ".join(f"w{i}" for i in range(1000))
    copies = spark.range(4000).select(F.lit(long).alias("text")).repartition(8)
    dealt = ngram_join.dealt(copies, 16, True).select(F.explode("grams"))
    assert dealt.count() <= 8 * 996
    mixed = spark.range(4000).select(F.concat(F.lit(long + " "), F.col("id").cast("string")).alias("text")).repartition(8)
    rows = ngram_join.dealt(mixed, 16, True).select(F.explode(F.arrays_zip("grams", "counts")).alias("x"))
    assert rows.where("x.counts >= 0").groupBy("x.grams").count().agg(F.max("count")).first()[0] <= 16  # 8 tasks of 500 texts, half of which are dealt at once
    # whole results: sets that share a passage in different batches still meet
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit(long + " "), F.col("id").cast("string")).alias("text")).repartition(8)
    assert {r["component_id"] for r in ngram_join.near_copies(docs).collect()} == {0}


def test_ngram_join_in_pieces(spark, monkeypatch):
    """Parts cut into many pieces give the same groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(ngram_join, "PART", 500)
    assert {r[0]: (r[1], r[3]) for r in ngram_join.near_copies(docs).collect()} == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.com/de/x?q", "http://example.com/fr/", "x://y.org/fr/?a", "http://net/", "http://a.net", "//no", None, "http://notexample.net/en/1"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)], "page_id long, url string, host int, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[2] == ("example.com", "/fr/", None, "allow")
    assert got[3] == ("y.org", "/fr/", "org/fr/", "allow")
    assert got[4] == ("net", "/", "net/", "block")
    assert got[5] == ("a.net", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("notexample.net", "/en/1", "net/", "block")
    assert url_filter.filter_urls(empty(pages), labels).count() == 0


def test_url_rules_are_mined(spark):
    """Pages of one host and word together are bad; each alone is not."""
    rows = [(i, f"http://{'spam' if i % 2 else 'fine'}.example.org/{'win' if i % 4 < 2 else 'read'}/{i}", i % 4 == 1) for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(bad)) for i, _, bad in rows if i < 120], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {i for i, _, bad in rows if bad}
    # the index finds what a search through all rules finds
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select(url_filter.url_tokens(F.col("url"), *url_filter.host_and_path(F.col("url"))).alias("tokens"), (F.col("toxic") == 1).alias("bad"))
    rules = url_filter.mine(labelled).collect()
    assert rules
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_filter.url_tokens(F.col("url"), *url_filter.host_and_path(F.col("url"))).alias("t")).collect()}
    for i, r in got.items():
        fits = [x for x in rules if set(x["tokens"]) <= tokens[i]]
        best = min(fits, key=lambda x: (-x["confidence"], -x["support"], x["rule"]), default=None)
        assert r["mined"] == (best and best["rule"])


def test_url_rules_on_the_given_pages(spark):
    """Rules are mined on three quarters of the pages with a known verdict and hold on the others."""
    sf = SF.replace("0.001", "0.1")
    known = url_filter.known_pages(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels")))
    held = F.crc32(F.col("page_id").cast("string")) % 4 == 2
    rules = url_filter.mine(known.where(~held).select("tokens", "bad")).collect()
    assert rules and all(r["lift"] >= 1.2 for r in rules)
    rows = [(r["bad"], any(set(x["tokens"]) <= set(r["tokens"]) for x in rules)) for r in known.where(held).collect()]
    caught = sum(m and b for b, m in rows)
    print(len(rules), caught, sum(m for _, m in rows), sum(b for b, _ in rows))
    assert caught / sum(m for _, m in rows) >= 0.8 and caught / sum(b for b, _ in rows) >= 0.6
    assert queries.QUERIES["op2_url_filter"](spark, sf).where("mined is not null").count() > 200


def test_url_tokens_that_are_always_together(spark):
    """Forty tokens that come together are one item, not 2 ** 40 sets."""
    rows = [([f"t{i:02}" for i in range(40)] + [f"u{k % 3}"], k % 2 == 0) for k in range(60)] + [(["v"], False)] * 60
    rules = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_confidence=0.4).collect()
    assert {r["rule"] for r in rules} == {"t00"}


def test_language_on_held_out_texts(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op3_language_id"](spark, sf).collect() if r["held_out"]]
    assert len(held) > 150
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_language_on_odd_rows(spark, odd):
    network = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    out = langid.identify(odd, network).collect()
    assert len(out) == odd.count()
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"]))) for r in out)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.train(empty(odd)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(empty(odd), network).count() == 0


def test_network_gradients():
    """The analytic gradient of the loss agrees with differences."""
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 256, (5, 32)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(5), y]).mean()
    for name, g in net.gradients(x, y).items():
        for spot in np.argsort(-np.abs(g).ravel())[:4]:
            at, was = np.unravel_index(spot, g.shape), net.p[name].flat[spot]
            net.p[name][at] = was + 1e-6
            up = loss()
            net.p[name][at] = was - 1e-6
            down = loss()
            net.p[name][at] = was
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5 * max(1, abs(g[at]))


def test_language_sample_keeps_every_label(spark):
    """More languages than the sample has room for: each has a window; a repeated row doesn't add up."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id") % 30).alias("lang"))
    network = langid.train(docs.union(docs), each=400, most=20)
    assert len(network.languages) == 30


def test_decontamination_on_odd_rows(spark, odd):
    tests = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve", 0), (1, "three four five six seven eight nine ten eleven twelve", 0), (2, "ONE-two", 0), (3, None, 0), (4, "!!", 0), (None, "nine ten", 0)], "item_id long, text string, key int")
    by = {r["doc_id"]: r for r in decontam.decontaminate(odd, tests).collect()}
    assert (by[1]["n_words"], by[1]["n_hit"], by[1]["items"]) == (12, 12, ["1", "2"])
    assert [tuple(s) for s in by[1]["spans"]] == [(0, 12)]
    assert (by[7]["n_hit"], by[8]["n_hit"], by[9]["n_hit"], by[4]["n_words"], by[5]["n_words"]) == (2, 2, 0, 0, 0)
    assert decontam.decontaminate(odd, tests).count() == odd.count()
    clean = decontam.clean(odd, tests)
    assert clean.columns == odd.columns
    assert {r["doc_id"] for r in clean.collect()} == {4, 5, 6, 9, 10, 11, None}
    cut = {r["doc_id"]: r["text"] for r in decontam.without_spans(spark.createDataFrame([(1, "a, B one two; c"), (2, "(one  TWO"), (3, None)], "doc_id long, text string"), tests).collect()}
    assert cut == {1: "a, B ; c", 2: "(", 3: None}
    assert decontam.decontaminate(odd, empty(tests)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(odd), tests).count() == 0


def test_decontamination_beyond_the_broadcast(spark, odd):
    """The shuffled way finds what the broadcast one finds; runs of windows merge as the hit words do."""
    text = " ".join("a b c a a b".split() * 40)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, text), (50, text), (51, "b " + text)], "doc_id long, text string"))
    tests = spark.createDataFrame([(1, "a a"), (2, "c"), (3, "a b c a a b a b c a a b"), (4, "one two")], "item_id long, text string")
    one, other = (sorted(map(repr, decontam.decontaminate(docs, tests, most_broadcast=m).collect())) for m in (2_000_000, 3))
    assert one == other
    for r in decontam.decontaminate(docs, tests).collect():
        if r["doc_id"] in (50, 51):
            words, hit = (text if r["doc_id"] == 50 else "b " + text).split(), set()
            for item in ("a a", "c", "a b c a a b a b c a", "b c a a b a b c a a", "c a a b a b c a a b"):
                own = item.split()
                hit |= {i + k for i in range(len(words)) if words[i : i + len(own)] == own for k in range(len(own))}
            assert {w for s in r["spans"] for w in range(s["at"], s["end"])} == hit and r["n_hit"] == len(hit)
            assert all(x["end"] < y["at"] for x, y in zip(r["spans"], r["spans"][1:]))


def brute_links(rows):
    fine = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, a) in enumerate(fine):
        for j, w, b in fine[:k]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in n if i is not None}


@pytest.mark.parametrize("block", [2048, 40])
def test_cover_trees_against_brute_force(spark, block):
    rng, rows = np.random.default_rng(3), []
    centres = rng.normal(size=(4, 8))
    for k in range(300):
        v = rng.normal(size=8) if k < 80 else centres[k % 4] + rng.normal(size=8) * rng.choice([0.001, 0.05, 0.12]) if k < 240 else np.array(rows[k - 200][1]) * rng.choice([1.0, 2.5])
        rows.append((k, [float(np.float32(x)) for x in v], None if k % 97 == 0 else k % 2))
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0], 1), (1004, [2.0], 1), (None, [1.0] * 8, 1), (1005, [1.0, None] + [1.0] * 6, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int")
    out = embed_dedup.link(df, block=block).collect()
    assert len(out) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None} == brute_links(rows)
    assert embed_dedup.link(empty(df)).count() == 0


def test_vectors_that_share_an_id(spark):
    """Links go by vector: two vectors of one vec_id keep their own links."""
    e = lambda i, x=0.0: [x if k == 7 else float(k == i) for k in range(8)]
    rows = [(5, e(0)), (5, e(1)), (6, e(0, 0.1)), (7, e(1, 0.1)), (8, e(1, 0.05))]
    out = embed_dedup.link(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]


def test_quotes_are_linked(spark):
    rows = [(1, 0, "a", "Hello there all.\nHow are you"), (1, 1, "b", "> Hello there all.\n> How are you\nFine, thanks"), (1, 2, "c", "On Monday b wrote:\n> > Hello there all.\n> Fine, thanks\nGood to hear"), (1, 3, "a", None), (1, 4, "d", "> good   TO hear\n\nYes"), (2, 0, "a", "> Hello there all.\nx"), (None, 1, "a", "> x\ny"), (3, None, None, "z"), (1, 3, "a", None), (1, 700, "e", "> Hello there all.\nlate")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, units int")
    out = chat.conversations(df)
    by = {(r["conv_id"], r["turn"]): (r["root"], r["parent"], r["depth"], r["text"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert by[1, 1] == (0, 0, 1, "Fine, thanks")
    assert by[1, 2] == (0, 1, 2, "Good to hear")
    assert by[1, 4] == (0, 2, 3, "Yes")
    assert by[1, 700] == (0, 0, 1, "late")
    assert by[1, 3] == (3, None, 0, "")
    assert by[2, 0] == (0, None, 0, "x")
    assert chat.conversations(empty(df)).count() == 0


def test_quotes_among_the_given_conversations(spark, monkeypatch):
    """Each given message quotes a drawn earlier one of its conversation, a third of all stand in one conversation; links and threads are known."""
    monkeypatch.setattr(chat, "RUN", 32)
    rng = np.random.default_rng(6)
    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id is not null and turn is not null and text is not null")
    own, parents, roots, rows = collections.defaultdict(list), {}, {}, []
    for i, r in enumerate(given.orderBy("conv_id", "turn", "text").collect()):
        conv = r["conv_id"] if r["conv_id"] % 3 else 0
        turn = len(own[conv])
        own[conv].append(f"{' '.join(r['text'].split())} number {i}")
        parent = int(rng.integers(turn)) if turn and rng.random() < 0.8 else None
        parents[conv, turn], roots[conv, turn] = parent, turn if parent is None else roots[conv, parent]
        rows.append((conv, turn, r["role"], own[conv][turn] if parent is None else f"On Friday x wrote:\n> {own[conv][parent]}\n{own[conv][turn]}"))
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert len(got) == len(rows) > 500 and len(own[0]) > len(rows) / 4
    assert {k: r["parent"] for k, r in got.items()} == parents
    assert {k: r["root"] for k, r in got.items()} == roots
    assert all(r["text"] == own[c][t] for (c, t), r in got.items())
    threads = collections.defaultdict(list)
    for r in chat.assembled(out).orderBy("conv_id", "root", "first_turn").collect():
        assert len(r["messages"]) <= 32 and (r["messages"][0]["turn"], r["messages"][-1]["turn"]) == (r["first_turn"], r["last_turn"])
        threads[r["conv_id"], r["root"]] += [(m["turn"], m["text"]) for m in r["messages"]]
    want, linked = collections.defaultdict(list), {c for (c, _), p in parents.items() if p is not None}
    for (c, t), root in sorted(roots.items()):
        want[c, root if c in linked else 0].append((t, own[c][t]))
    assert threads == want


def test_assembled_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 8)
    rows = [(1, 0, "a", "Hello there"), (1, 1, "b", "no quote"), (None, 3, "a", "x"), (None, 3, "a", "x"), (2, None, "a", None), *[(1, 2, "c", "again")] * 40]
    out = chat.assembled(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sum(len(r["messages"]) for r in out) == len(rows)
    assert max(len(r["messages"]) for r in out) <= 16
    assert sorted([m["turn"] for m in r["messages"]] for r in out if r["conv_id"] == 1 and r["first_turn"] == 0) == [[0, 1]]
    assert {r["root"] for r in out if r["conv_id"] == 1} == {0}
    assert sum(r["conv_id"] is None for r in out) == 2 and sum(r["conv_id"] == 2 for r in out) == 1
    assert chat.assembled(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_query_keeps_all_messages(spark):
    assert queries.QUERIES["op6_chat"](spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_archives_come_back(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nX: y", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "z" * 200_000), (None, "u", "<p>é</p>"), (1, "http://b/\r\nX: y", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages, folder, roll_bytes=300)
    assert manifest.groupBy().sum("n_records").first()[0] == len(rows)
    out = warc.read(spark, folder).collect()
    assert len(out) == len(rows) and all(r["intact"] for r in out)
    digest = lambda t: __import__("base64").b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for r in out:
        html = next(h for i, _, h in rows if i == r["page_id"])
        assert (r["payload_digest"], r["payload_bytes"]) == (digest(html), len((html or "").encode()))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == (html or "").encode()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in out)
    assert kinds == [("1", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", 1), ("4", "response", None), ("5", "revisit", 2), ("None", "revisit", 1)]
    again = warc.write(pages, f"file://{tmp_path}/again", roll_bytes=300)
    assert sorted(r["sha256"] for r in again.collect()) == sorted(r["sha256"] for r in manifest.collect())
    assert warc.by_file(manifest).rdd.getNumPartitions() == manifest.count() > 1
    warc.write(empty(pages), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_that_stop_are_not_there(spark, tmp_path, monkeypatch):
    """A run that stops before its manifest is in place leaves no archive; the next one is whole and removes what was left."""
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write(pages.where("page_id < 5"), folder)
    with monkeypatch.context() as m:
        m.setattr(warc, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            warc.write(pages, folder, roll_bytes=300)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        warc.read(spark, folder)
    assert any(f.name.startswith("_tmp-") for f in (tmp_path / "w").iterdir())
    files = {r["file"] for r in warc.write(pages, folder, roll_bytes=300).collect()}
    assert {f.name for f in (tmp_path / "w").iterdir() if not f.name.endswith(".crc")} == files | {"manifest"}
    assert sorted(r["page_id"] for r in warc.read(spark, folder).collect()) == list(range(20))


def test_mix_on_odd_rows(spark, odd):
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(mixing.taken_words(odd).collect(), key=repr) == sorted(rows, key=repr)
    assert mixing.taken_words(empty(odd)).count() == 0
    assert {r["taken"] for r in mixing.taken_words(odd.where("doc_id in (4, 5, 6)")).collect()} == {0}


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces, placed = mixing.mix(docs)
    by = {r["src"]: r for r in placed.groupBy("src").agg(F.max("target").alias("target"), F.max("source_size").alias("size")).collect()}
    got = {r["src"]: r["n"] for r in pieces.groupBy("src").agg(F.sum("n_words").alias("n")).collect()}
    for src, r in by.items():
        assert abs(got.get(src, 0) - r["target"]) <= 192  # three blocks
        assert got.get(src, 0) <= 3 * r["size"]
    # any stretch of the schedule holds the sources near their shares
    slots = pieces.where("slot between 200 and 399").groupBy("src").agg(F.countDistinct("slot").alias("n")).collect()
    whole = sum(r["target"] for r in by.values())
    assert all(abs(r["n"] - 200 * by[r["src"]]["target"] / whole) <= 4 for r in slots)


def test_mixed_texts_are_the_documents_words(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {r["doc_id"]: r["text"].split() for r in docs.where("text is not null").collect()}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    rows = mixing.mixed_texts(docs).collect()
    got = collections.Counter()
    for r in rows:
        own = words[r["doc_id"]][r["from_word"] : r["from_word"] + r["n_words"]]
        assert re.split(r"[\x20\x09-\x0D]+", r["text"]) == own and len(own) == r["n_words"]
        got[r["doc_id"]] += r["n_words"]
    assert got == collections.Counter({d: n for d, n in taken.items() if n})
    assert [(r["slot"], r["part"]) for r in rows] == sorted((r["slot"], r["part"]) for r in rows)
    assert mixing.mixed_texts(empty(odd)).count() == 0
    assert sum(r["n_words"] for r in mixing.mixed_texts(odd).collect()) == sum(r["taken"] for r in mixing.taken_words(odd).collect())


def test_license_places_against_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, "MIT license; mit LICENSE cc-by apache license"), (-2, "gnu general public\nlicense"), (-3, "the license of mit"), (-4, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {r["doc_id"]: r for r in license_scan.scan(both).collect()}
    for r in both.collect():
        words = WORD.findall((r["text"] or "").translate(LOWER))
        places = sorted((i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert got[r["doc_id"]]["n_words"] == len(words)
        assert [tuple(x) for x in got[r["doc_id"]]["base"]] == places
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(empty(odd)).count() == 0
    notice = spark.createDataFrame([(1, "x y. This work is licensed under the GNU General Public License, version 3. z"), (2, "public general work of gnu version 3")], "doc_id long, text string")
    found = {r["doc_id"]: [x["label"] for x in r["found"]] for r in license_scan.scan(notice).collect()}
    assert found == {1: ["gpl-3.0"], 2: []}


def test_licenses_without_their_titles(spark):
    """Standard headers and permission texts, wrapped and commented as in sources, in other words, and what only resembles them."""
    gpl = "# {x} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {k}General Public License as published by\n# the Free Software Foundation, either version {v} of the License, or\n# (at your option) any later version.\n"
    mit = 'Copyright (c) 2020 A. Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    isc = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    bsd = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    apache = '/* Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License. */'
    texts = {"gpl-3.0": gpl.format(x="X", k="", v=3), "gpl-2.0": gpl.format(x="This program", k="", v=2), "lgpl": gpl.format(x="X", k="Lesser ", v=3), "agpl-3.0": gpl.format(x="X", k="Affero ", v=3), "apache-2.0": apache, "mit": mit, "isc": isc.format("/or"), "bsd": bsd}
    rows = [*texts.items(), ("isc", isc.format("")), ("lgpl", gpl.format(x="X", k="Library ", v=2)), ("", "permission is granted to any person"), ("", mit.split()[0] + " free software of any person, hereby granted a copy")]
    docs = spark.createDataFrame([(i, f"{'words before ' * i}{t}{' and after' * 9}") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: [x["label"] for x in r["found"]] for r in license_scan.scan(docs).collect()}
    assert found == {i: [label] if label else [] for i, (label, _) in enumerate(rows)}


def test_licenses_cut_edited_and_by_name(spark):
    """Of whole passages with a word in thirty changed, cut anywhere, nine in ten and more are found; short names are found, other texts aren't."""
    rng, rows = np.random.default_rng(4), []
    whole = {}
    for label, _, notice in license_scan.TEMPLATES:
        if len(notice.split()) >= 12:
            whole.setdefault(label, []).append(notice)
    for label, notices in whole.items():
        for _ in range(6):
            words = " ".join(notices).split()
            words = [f"edit{k}" if rng.random() < 1 / 30 else w for k, w in enumerate(words)]
            cut = rng.integers(0, max(1, len(words) // 4))
            rows.append((label, " ".join(["before"] * 7 + words[cut:] + ["after"])))
    named = {"SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "under GPLv3.": "gpl-3.0", "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0", "spdx license": None, "the software is provided to any person": None}
    texts = [t for _, t in rows] + list(named)
    got = {r["doc_id"]: {x["label"] for x in r["found"]} for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = sum(label in got[i] for i, (label, _) in enumerate(rows))
    print(hit, len(rows), [label for i, (label, _) in enumerate(rows) if label not in got[i]])
    assert hit / len(rows) >= 0.9
    assert [got[len(rows) + i] for i in range(len(named))] == [{x} if x else set() for x in named.values()]


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.QUERIES["op10_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == t for p, t in held) / len(held) >= 0.97
    assert sum(p and t for p, t in held) / sum(t for _, t in held) >= 0.85


def field():
    return toxicity.Field({"w=awful": 6.0, "b4=nast": 5.0}, -4.0, np.array([[0.5, -0.5], [-0.5, 0.3]]), np.array([-2.0, 1.5, 2.0]))


def test_marginals_against_all_paths():
    rng, f = np.random.default_rng(1), field()
    lengths = np.array([5, 0, 1, 7])
    e = rng.normal(size=lengths.sum())
    got, at = toxicity.marginals(e, lengths, f.steps), 0
    for n in lengths:
        own = e[at : at + n]
        paths = [tuple((p >> i) & 1 for i in range(n)) for p in range(2**n)]
        weight = np.array([np.exp(sum(own[i] * s[i] for i in range(n)) + sum(f.steps[s[i - 1], s[i]] for i in range(1, n))) for s in paths])
        for i in range(n):
            p = sum(w for w, s in zip(weight, paths, strict=True) if s[i]) / weight.sum()
            assert abs(toxicity.sigmoid(got[at + i]) - p) < 1e-9
        at += n


def test_marginals_of_a_very_long_text():
    """Cut into stretches, messages are the same."""
    rng, f = np.random.default_rng(2), field()
    lengths = np.array([700, 3, 0, 64, 129])
    e = rng.normal(size=lengths.sum())
    assert np.allclose(toxicity.marginals(e, lengths, f.steps, block=16), toxicity.marginals(e, lengths, f.steps, block=1 << 20))


def test_toxic_spans_and_odd_rows(spark, odd):
    text = "An AWFUL, awful thing; and nasties."
    out = toxicity.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), field()).first()
    assert [text[s["start"] : s["end"]] for s in out["spans"]] == ["AWFUL, awful", "nasties"]
    rows = toxicity.tag(odd, field())
    assert rows.count() == odd.count() and set(rows.columns) == {*odd.columns, "spans"}
    assert all(0 <= r["score"] <= 1 for r in rows.collect())
    assert toxicity.tag(empty(odd), field()).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.train(odd, labels) is None
    assert {r["score"] for r in toxicity.tag(odd, None).collect()} == {0.0}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tox, lang, near, clean, _ = (f for _, f in pipeline.STAGES)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in near(spark, docs, SF).collect()} == {d for d, (_, c) in groups.items() if c == d}
    hit = {r["doc_id"] for r in queries.QUERIES["op4_decontaminate"](spark, SF).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in clean(spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - hit
    for stage in (tox, lang, near, clean):
        assert stage(spark, docs, SF).columns == docs.columns
    rows = pipeline.run(spark, SF)
    assert 0 < rows.select("doc_id").distinct().count() <= docs.count()
    assert rows.columns == ["slot", "part", "source", "doc_id", "pass", "from_word", "n_words", "text"]
    assert rows.where("n_words < 1 or text = ''").count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, repeats, empty and very long texts, an empty table and clashing names, through every stage."""
    import corpus_pipeline as pipeline

    for docs in (odd, empty(odd)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
