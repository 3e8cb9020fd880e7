"""N-gram Jaccard join by vertical partitioning, and the groups of near copies it gives.

Each text is a set of hashed word shingles. The n-gram space is cut into fragments; each fragment is counted on its own,
and the partial counts are summed per set or per pair:

1. Equal sets become one class (copies are never paired, and a task deals a set's n-grams once).
2. In a fragment that holds a fixed share of the hash space, shingles that only one class holds are counted. A
   link leaves at most n / 5 shingles of either set unmatched, so a class with more unmatched ones in the fragment
   alone links with nothing and is done. N-grams are counted within each batch of texts before they are shuffled.
3. One row of each remaining class is dealt; its n-grams get their global order, rarest first: counts are summed for each n-gram, then
   joined back to the sets piece by piece, so that the holders of a frequent n-gram are never in one group. Each class is indexed under its
   first n / 5 + 1 n-grams of that order; linked classes meet under one of them.
4. Under an n-gram, classes are compared with a leader, and only the leader's pairs are made: near copies fall into one component
   after a few rounds and need no further pairs. All pairs of different components that still meet are then
   compared, so that no link between components is lost, however many rounds there were.
5. A pair's overlap is counted for each fragment of the global order (ranges of frequency) and summed.

Sets are known by 64-bit sums of mixed shingle hashes. Threshold: 100 * intersection >= 80 * union.

Nulls, ties, empty inputs: null or wordless texts have empty sets, link with nothing and are their own component; texts of
fewer than 5 words are one shingle; rows without doc_id link like others but name no component (null if no row of it has a doc_id);
rows that repeat, or share a doc_id, are judged each by its own text; the smallest doc_id names a component; an empty table gives an empty result. Other columns are ignored.
Very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm import shared
from quarrylog.llm.shared import bounded_batches, components, small, stash

WIDTH = 5
#: Share of the hash space that step 2's fragment holds.
SHARE = 0.3
#: N-grams that one task of a fragment holds, about, and that a task deals at once, so that few arrays of them are in memory.
PART, AT_ONCE = 1_000_000, 500_000
#: Ranges of frequency, by doubling, that the global order is cut into.
FRAGMENTS = 6

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """word -> its hash, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. bytes.lower and bytes.split know only A-Z and ASCII blanks."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * MULTIPLIERS[i % 5] + np.uint64(i)
    return np.unique(mixed(out))


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary() if pa.types.is_string(batch.column("text").type) else pa.large_binary()).to_pylist()


def set_id(s: np.ndarray) -> int:
    return int(mixed(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64))


def low_end(s: np.ndarray) -> int:
    """How many of a sorted set lie in step 2's fragment."""
    return int(np.searchsorted(s, np.uint64(int(SHARE * 2**64))))


def key_of() -> F.Column:
    """Names the rows of one doc_id and text."""
    return F.xxhash64("doc_id", "text")


def set_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, n (set size), sid (null for empty sets), low (n-grams in step 2's fragment)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [(len(s), set_id(s), low_end(s)) if len(s) else (0, None, 0) for s in (shingles(t, hashes) for t in texts_of(batch))]
            n, sid, low = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(low, pa.int64())], ["doc_id", "key", "n", "sid", "low"])

    bounded_batches(docs.sparkSession, 4 << 20)
    return docs.select(F.col("doc_id").cast("long"), key_of().alias("key"), "text").mapInArrow(sets, "doc_id long, key long, n long, sid long, low long")


def packed(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each part, with its stretch of each column as an array."""
    order = np.argsort(part, kind="stable")
    own, at = np.unique(part[order], return_index=True)
    ends = pa.array(np.append(at, len(part)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns.values()]], ["part", *columns])


def dealt(docs: DataFrame, parts: int, tally: bool, only_low: bool = False) -> DataFrame:
    """docs (text) -> part, sids, grams (and counts): the n-grams of texts, some AT_ONCE at a time, dealt over parts by hash and packed into arrays.

    A task deals each set once, however many copies it reads. With tally, an n-gram is dealt once each time: with one of its sets and
    the number of all. Where that is more than one, its sets know already that they share it: they are told by rows with
    count -1 and, in grams, how many such n-grams a set has. So no n-gram, however frequent, brings more than an entry each time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """The sets that are new to this task, some AT_ONCE n-grams at a time."""
        hashes, seen, found, size = WordHashes(), set(), [], 0
        for batch in batches:
            for s in (shingles(t, hashes) for t in texts_of(batch)):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    found.append((i, s[: low_end(s)].copy() if only_low else s))
                    size += len(found[-1][1])
                    if size >= AT_ONCE:
                        yield found
                        found, size = [], 0
        if size:
            yield found

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in read(batches):
            grams = np.concatenate([s for _, s in found])
            sids = np.repeat(np.array([i for i, _ in found], np.int64), [len(s) for _, s in found])
            if not tally:
                yield packed((mixed(grams) % np.uint64(parts)).astype(np.int64), {"sids": sids, "grams": grams.view(np.int64)})
                continue
            order = np.argsort(grams, kind="stable")
            grams, sids = grams[order], sids[order]
            at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            count = np.diff(np.append(at, len(grams)))
            told, n = np.unique(sids[np.repeat(count > 1, count)], return_counts=True)
            grams, sids = grams[at], sids[at]
            part = np.append((mixed(grams) % np.uint64(parts)).astype(np.int64), mixed(told.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield packed(part, {"sids": np.append(sids, told), "grams": np.append(grams.view(np.int64), n), "counts": np.append(count, np.full(len(told), -1)).astype(np.int32)})

    return docs.select("text").mapInArrow(deal, "part long, sids array<long>, grams array<long>" + (", counts array<int>" if tally else ""))


def tallied(table: pa.Table) -> tuple[np.ndarray, ...]:
    """A part's dealt n-grams by gram: sids, grams, counts, where each n-gram starts, and which n-grams more than one set holds; and the rows that tell sets."""
    sids, grams, counts = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("sids", "grams", "counts"))
    tells = counts < 0
    told = sids[tells], grams[tells]
    sids, grams, counts = sids[~tells], grams[~tells], counts[~tells]
    order = np.lexsort((sids, grams))
    sids, grams, counts = sids[order], grams[order], counts[order]
    at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    if not len(at):
        return sids, grams, counts, at, np.empty(0, bool), told
    several = np.maximum.reduceat(counts, at) > 1
    several |= np.minimum.reduceat(sids, at) != np.maximum.reduceat(sids, at)
    return sids, grams, counts, at, several, told


def shared_counts(table: pa.Table) -> pa.Table:
    """sid, shared: parts of the number of a set's n-grams that other sets hold too; at least that number in sum."""
    sids, grams, counts, at, several, told = tallied(table)
    ours = np.repeat(several, np.diff(np.append(at, len(grams)))) & (counts == 1)
    ours[1:] &= (grams[1:] != grams[:-1]) | (sids[1:] != sids[:-1])
    own, n = np.unique(sids[ours], return_counts=True)
    return pa.table({"sid": pa.array(np.append(own, told[0]), pa.int64()), "shared": pa.array(np.append(n, told[1]), pa.int64())})


def frequencies(table: pa.Table) -> pa.Table:
    """part, grams, counts: the n-grams that more than one set holds with how often they were dealt, and splits: the pieces to cut the part's entries into."""
    _, grams, counts, at, several, _ = tallied(table)
    sums = np.add.reduceat(counts.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int64()), "splits": pa.array([int(-(-sums.sum() // PART))], pa.int64()), "grams": one(grams[at][several]), "counts": one(sums[several])})


def segments(left: pa.Table, right: pa.Table) -> pa.Table:
    """sid, grams, counts: a set's n-grams in this piece of a part that other sets hold too. right: the part's shared n-grams, in order."""
    sids, grams = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("sids", "grams"))
    known, count = (right.column(c).combine_chunks().flatten().to_numpy() for c in ("grams", "counts"))
    if not len(sids) or not len(known):
        return pa.table({"sid": pa.array([], pa.int64()), "grams": pa.array([], pa.list_(pa.int64())), "counts": pa.array([], pa.list_(pa.int64()))})
    spot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    own = known[spot] == grams
    sids, grams, spot = sids[own], grams[own], spot[own]
    order = np.lexsort((grams, sids))
    sids, grams, spot = sids[order], grams[order], spot[order]
    new = np.ones(len(sids), bool)
    new[1:] = (sids[1:] != sids[:-1]) | (grams[1:] != grams[:-1])
    sids, grams, spot = sids[new], grams[new], spot[new]
    first, at = np.unique(sids, return_index=True)
    ends = pa.array(np.append(at, len(sids)).astype(np.int32))
    return pa.table({"sid": pa.array(first, pa.int64()), "grams": pa.ListArray.from_arrays(ends, pa.array(grams, pa.int64())), "counts": pa.ListArray.from_arrays(ends, pa.array(count[spot], pa.int64()))})


def parts_for(grams: int) -> int:
    """Parts follow the n-grams alone: each adds a row to every set that has n-grams in it."""
    return max(16, -(-grams // PART))


def candidates(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and their stashed set table -> indexed classes (sid, n, toks: count and gram, rarest first, take: how many of them index it), classes (sid, rep, key, n, low)."""
    classes = stash(sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n").alias("n"), F.max("low").alias("low")), "classes")
    totals = classes.agg(F.sum("n").alias("n"), F.sum("low").alias("low")).first()
    low = dealt(docs, parts_for(totals["low"] or 0), True, True).groupBy("part").applyInArrow(shared_counts, "sid long, shared long")
    shared = low.groupBy("sid").agg(F.sum("shared").alias("shared"))
    left = classes.join(shared, "sid", "left").where("coalesce(shared, 0) >= low - floor(n / 5)").select("sid", "key", "n")
    left = stash(left, "left-classes")
    parts = parts_for(left.agg(F.sum("n")).first()[0] or 0)
    # one row of each class that is left
    few = docs.withColumn("key", key_of()).join(small(left.select("key").distinct(), 1_000_000), "key", "left_semi")
    known = stash(dealt(few, parts, True).groupBy("part").applyInArrow(frequencies, "part long, splits long, grams array<long>, counts array<long>"), "frequencies")
    splits = small(known.select("part", "splits"), 1_000_000)
    own = dealt(few, parts, False).join(splits, "part").withColumn("split", F.pmod(F.xxhash64("part", F.element_at("sids", 1), F.size("sids")), "splits")).select("part", "split", "sids", "grams")
    known = known.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), "grams", "counts")
    own = own.groupBy("part", "split").cogroup(known.groupBy("part", "split")).applyInArrow(segments, "sid long, grams array<long>, counts array<long>")
    # a set that several tasks dealt has the same segments from each; they are held once
    toks = own.groupBy("sid").agg(F.sort_array(F.flatten(F.collect_set(F.arrays_zip("counts", "grams")))).alias("toks"))
    indexed = left.select("sid", "n").join(toks, "sid").withColumn("take", (F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("toks"))).cast("int")).where("take > 0")
    return stash(indexed, "indexed"), classes


def fragment(count) -> F.Column:
    """Ranges of frequency: the global order, rarest first, cut where the frequency doubles."""
    return F.least(F.floor(F.log2(count.cast("double"))), F.lit(FRAGMENTS)).cast("int")


def pieces(indexed: DataFrame) -> DataFrame:
    """sid, fragment, grams: each set's n-grams in each fragment of the global order that it reaches."""
    parts = F.array(*[F.struct(F.lit(i).alias("fragment"), in_fragment(i).alias("grams")) for i in range(1, FRAGMENTS + 1)])
    return indexed.select("sid", F.explode(F.filter(parts, lambda p: F.size(p["grams"]) > 0)).alias("p")).select("sid", "p.fragment", "p.grams")


def in_fragment(i: int):
    return F.transform(F.filter("toks", lambda t: fragment(t["counts"]) == i), lambda t: t["grams"])


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """pairs (a, b, na, nb) -> those that link: partial overlaps are counted in each fragment and summed per pair."""
    left, right = cut.toDF("a", "fragment", "ga"), cut.toDF("b", "fragment", "gb")
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    summed = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("common"))
    return summed.where("100 * common >= 80 * (na + nb - common)").select("a", "b", "common")


def meeting(posted: DataFrame) -> DataFrame:
    """posted (gram, sid, n, slack, comp) -> the pairs of different components that meet under an n-gram and may link.

    A link has 9 * common >= 4 * (na + nb). With pa n-grams before it in a's order, the first one in common leaves
    na - pa that can match, and so for b: the slacks 9 * p - n are at most 4 * (na - nb) and 4 * (nb - na), one of them 0 or less.
    """
    two = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "slack", "comp")]
    may = "slack_a <= 4 * (n_a - n_b) and slack_b <= 4 * (n_b - n_a) and (slack_b > 0 or sid_a < sid_b) and comp_a <> comp_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"
    met = posted.where("slack <= 0").select("gram", *two("a")).join(posted.select("gram", *two("b")), "gram").where(may)
    low, high = (lambda c: F.when(F.col("sid_a") < F.col("sid_b"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))), (lambda c: F.when(F.col("sid_a") < F.col("sid_b"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    return met.select(low("sid").alias("a"), high("sid").alias("b"), low("n").alias("na"), high("n").alias("nb")).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def postings(indexed: DataFrame) -> DataFrame:
    """gram, sid, n, slack: each class under its first n-grams of the global order, where another class is that it may link with."""
    before = F.col("n") - F.size("toks")  # n-grams that no other class has come first
    rows = indexed.select("sid", "n", before.alias("before"), F.posexplode(F.slice("toks", 1, F.col("take"))).alias("i", "t"))
    rows = rows.select(F.col("t.grams").alias("gram"), "sid", "n", (9 * (F.col("before") + F.col("i")) - F.col("n")).alias("slack"))
    several = rows.groupBy("gram").agg(F.count("*").alias("m"), F.min("slack").alias("least")).where("m > 1 and least <= 0").select("gram", "least")
    return stash(rows.join(several, "gram").where("slack + least <= 0").drop("least"), "postings")


def links(docs: DataFrame) -> DataFrame:
    """The join itself: a, b, common for every two different sets that link, a < b; sets are named by sid as in set_table."""
    indexed, _ = candidates(docs, stash(set_table(docs), "sets"))
    return overlaps(meeting(postings(indexed).withColumn("comp", F.col("sid"))), stash(pieces(indexed), "pieces"))


def grouped(indexed: DataFrame, rounds: int = 4) -> DataFrame | None:
    """sid -> root for all classes that link with another, or None if none does."""
    posted, cut = postings(indexed), stash(pieces(indexed), "pieces")
    edges, roots, before = None, None, float("inf")

    def with_comp() -> DataFrame:
        if roots is None:
            return posted.withColumn("comp", F.col("sid"))
        return posted.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")

    for i in range(rounds + 1):
        now = with_comp()
        order = (F.col("slack") if i % 2 == 0 else F.lit(0)).alias("s"), F.xxhash64("sid", F.lit(i)).alias("o")
        lead = F.min(F.when(F.col("slack") <= 0, F.struct(*order, "sid", "n", "slack", "comp"))).alias("lead")
        by_comp = now.groupBy("gram", "comp").agg(F.count("*").alias("m"), F.count_if(F.col("slack") <= 0).alias("light"), lead)
        sums = F.count("*").alias("comps"), F.sum("m").alias("m"), (F.sum("m") * F.sum("light") - F.sum(F.col("m") * F.col("light"))).alias("pairs"), F.min("lead").alias("lead")
        open_ = by_comp.groupBy("gram").agg(*sums).where("comps > 1 and lead is not null")
        open_ = stash(open_.select("gram", "m", "pairs", F.col("lead.sid").alias("a"), F.col("lead.n").alias("na"), F.col("lead.slack").alias("sa"), F.col("lead.comp").alias("ca")), "open")
        work = open_.agg(F.sum("pairs").alias("pairs"), F.sum("m").alias("rows")).first()
        if not work["rows"]:
            break
        now = now.join(open_, "gram")
        last = i == rounds or work["pairs"] <= 4 * work["rows"] or work["pairs"] > before / 2  # a further round would save little
        before = work["pairs"]
        if last:
            pairs = meeting(now.select("gram", "sid", "n", "slack", "comp"))
        else:
            pairs = now.where("ca <> comp and sa <= 4 * (na - n) and slack <= 4 * (n - na) and 5 * least(na, n) >= 4 * greatest(na, n)").groupBy("sid", "a").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("n").alias("nb"))
            pairs = pairs.groupBy("sid").agg(F.max(F.struct("k", "a", "na", "nb")).alias("p")).select("p.a", F.col("sid").alias("b"), "p.na", "p.nb")
        new = stash(overlaps(pairs, cut).select("a", "b"), "links")
        if new.limit(1).count():
            edges = new if edges is None else edges.union(new)
            roots = components(edges)
        if last:
            break
    return roots


def groups_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, n, sid, root (the sid that names a row's group; null for empty sets), component_id."""
    docs = docs.select("doc_id", "text")
    sets = stash(set_table(docs), "sets")
    indexed, classes = candidates(docs, sets)
    roots = grouped(indexed)
    named = classes.select("sid", "rep")
    if roots is None:
        named = named.select("sid", F.col("sid").alias("root"), F.col("rep").alias("component_id"))
    else:
        named = named.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        first = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.join(first, "root").select("sid", "root", "component_id")
    return sets.join(named, "sid", "left").select("doc_id", "key", "n", "sid", "root", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, sid, component_id: the smallest doc_id that links reach."""
    return groups_of(docs).select("doc_id", F.col("n").alias("n_shingles"), "sid", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, but one for each group: that of the smallest doc_id (rows without one come last), then set, then text.

    Groups go by texts, not by doc_ids: of rows that share a doc_id, each is judged by its own text. Rows of equal doc_id and text that
    differ elsewhere leave the first by all their columns. Texts without words are in no group: all their rows stay.
    """
    found = stash(groups_of(docs).where("root is not null").select("doc_id", "key", "sid", "root"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid", "key")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    rows = found.groupBy("doc_id", "key", "root").agg(F.count("*").alias("n"), F.min("sid").alias("sid")).join(best, "root").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "n", (order == F.col("best")).alias("stays"))
    rows = stash(rows, "group-rows")
    same = (F.col("_own") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_doc"))
    own, columns = shared.packed(docs.columns)
    kept = docs.select(key_of().alias("_own"), F.col("doc_id").cast("long").alias("_id"), own).join(small(rows.where("not stays").select("_doc", "_key"), 1_000_000), same, "left_anti")
    again = small(stash(rows.where("stays and n > 1").select("_doc", "_key"), "group-repeats"), 1_000_000)
    if not again.limit(1).count():
        return kept.select(*columns)
    one = kept.join(again, same, "left_semi").groupBy("_id", "_own").agg(F.min_by("own", F.to_json("own")).alias("own"))
    return kept.join(again, same, "left_anti").select("own").unionByName(one.select("own")).select(*columns)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
p as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, p.b from r join p on p.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by 1) m using (doc_id)
"""
