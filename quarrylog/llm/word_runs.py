"""Periodic runs of words: an enhanced suffix array, branching tandem repeats by ISA lookups, rotation and merging into runs.

A run is a stretch of consecutive words with smallest period q, as long as can be, that repeats at least three times and
has a least length. Texts of a batch lie one after another in one array of numbers, each text with an alphabet of its own, so one suffix
array by prefix doubling serves them all and no common prefix crosses a border. Of each LCP interval of depth q, the suffixes i of all
children but the largest look whether i + q or i - q, by the inverse suffix array, lies in the same interval: if so, and the next
words differ, a square ends there that no rotation to the right continues. Squares are rotated to the left as far as they go; those of
multiples of a period end in the same place and merge with it. Intervals are pairs of bounds from the LCP array; no tree is built.

Nulls, ties, empty inputs: a null, empty or blank text has no words and no runs; rows that repeat are judged alike, row by row; a
very long text is a batch of its own; equal exponents are ordered by start, then period; an empty table gives an
empty result. Other columns, whatever their names, are kept as they are, but n_words, runs and
collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.shared import BLANKS, bounded_batches, packed

#: Words of the texts that are searched together.
AT_ONCE = 200_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words until all differ; a suffix that ends earlier comes first.

    Each round sorts only suffixes that share their rank with others.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    fresh = np.r_[True, s[order][1:] != s[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # rank: the first place of the suffixes that share it
    levels, width = [rank], 1
    while True:
        many = np.bincount(rank, minlength=n)[rank] > 1
        own = np.flatnonzero(many)
        if not len(own):
            return levels
        after = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        at = np.arange(len(own))
        group = np.r_[True, key[1:] // (n + 1) != key[:-1] // (n + 1)]
        fresh = np.r_[True, key[1:] != key[:-1]]
        within = at - at[group][np.cumsum(group) - 1]
        first = within[fresh][np.cumsum(fresh) - 1]
        rank = rank.copy()
        rank[own] = key // (n + 1) + first
        levels.append(rank)
        width *= 2


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, by the ranks from the widest down."""
    n, length = len(levels[0]), np.zeros(len(i), np.int64)
    i, j = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        step = np.where(same, 1 << k, 0)
        length += step
        i += step
        j += step
    return length


def nearest_smaller(x: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place with a value above 0 the last one before it with a smaller value (or an equal one), -1 if there is none; links are followed all at once."""
    at = np.arange(-1, len(x) - 1)
    own = np.flatnonzero(x)
    own = own[own > 0]
    while len(own):
        far = x[at[own]] > x[own] if or_equal else x[at[own]] >= x[own]
        own = own[far & (at[own] >= 0)]
        at[own] = at[at[own]]
        own = own[at[own] >= 0]
    return at


def squares(s: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares in s that can't be rotated to the right and may end a run of so many repeats and words."""
    levels = ranks(s)
    n, isa = len(s), levels[-1]
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)  # lcp[k]: of sa[k - 1] and sa[k]; 0 on both ends
    lcp[1:n] = common(levels, sa[:-1], sa[1:])
    mark = np.flatnonzero(lcp[:n])
    before, before_or_equal = nearest_smaller(lcp, False), nearest_smaller(lcp, True)
    after, after_or_equal = (n - nearest_smaller(lcp[::-1], e)[::-1] for e in (False, True))
    low, high, depth = before[mark], after[mark] - 1, lcp[mark]
    # a run of that length holds this many occurrences of its period's words, all in the interval
    enough = high - low + 1 >= np.maximum(repeats, least // depth)
    mark, low, high, depth = mark[enough], low[enough], high[enough], depth[enough]
    opens = before_or_equal[mark] == low  # the first mark of its interval also ends the first child
    child = np.concatenate([np.stack([low[opens], mark[opens] - 1]), np.stack([mark, after_or_equal[mark] - 1])], axis=1)
    low, high, depth = (np.concatenate([x[opens], x]) for x in (low, high, depth))
    size = child[1] - child[0] + 1
    order = np.lexsort((size, depth, low))
    last = np.r_[(low[order][1:] != low[order][:-1]) | (depth[order][1:] != depth[order][:-1]), True] if len(order) else np.zeros(0, bool)
    own = order[~last]  # all children but the largest
    size = size[own]
    part = np.repeat(own, size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + child[0][part]
    i, q, low, high = sa[place], depth[part], low[part], high[part]

    def there(j: np.ndarray) -> np.ndarray:
        at = isa[np.clip(j, 0, n - 1)]
        return (j >= 0) & (j < n) & (at >= low) & (at <= high)

    ahead, behind = there(i + q), there(i - q)
    start, period = np.concatenate([i[ahead], i[behind] - q[behind]]), np.concatenate([q[ahead], q[behind]])
    end = start + 2 * period
    ended = (end >= n) | (s[np.minimum(end, n - 1)] != s[np.minimum(start + period, n - 1)])
    found = np.unique(np.stack([period[ended], start[ended]], axis=1), axis=0)
    return found[:, 1], found[:, 0]


def left_rotations(s: np.ndarray, start: int, period: int) -> int:
    """How many words before start, too, equal those a period later; looked at in stretches of growing length."""
    done, step = 0, 32
    while start - done > 0:
        low = max(0, start - done - step)
        differ = np.flatnonzero(s[low : start - done] != s[low + period : start - done + period])
        if len(differ):
            return start - low - int(differ[-1]) - 1
        done, step = start - low, step * 2
    return done


def runs(s: np.ndarray, least: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the numbers s, by start and period."""
    if len(s) < max(least, repeats):
        return []
    ending: dict[int, list[tuple[int, int]]] = {}
    out = []
    for start, q in zip(*(x.tolist() for x in squares(s, least, repeats)), strict=True):  # by rising period
        end = start + 2 * q
        same_end = ending.setdefault(end, [])
        if any(s0 <= start and q % q0 == 0 for s0, q0 in same_end):
            continue
        start -= left_rotations(s, start, q)
        same_end.append((start, q))
        if end - start >= max(least, repeats * q):
            out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], least: int, repeats: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words, all texts in one array."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    s = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(lengths.sum()))
    s += np.repeat(np.arange(len(texts)), lengths) * len(numbers)
    starts = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in runs(s, least, repeats):
        t = int(np.searchsorted(starts, start, side="right")) - 1
        out[t].append((start - int(starts[t]), length, q))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, without those that lie in a run behind its first period."""
    if found:
        keep = np.ones(len(words), bool)
        for start, length, q in found:
            keep[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: Column, keep: list[str] | None = None, least: int = 24, repeats: int = 3) -> DataFrame:
    """docs and a text made of their columns -> the columns to keep, or all, with n_words, runs (start, length, period, by start and period) and collapsed, the text without repetitions."""
    own, kept = packed([c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed")])
    bounded_batches(docs.sparkSession)
    rows = docs.select(text.alias("text"), own)
    out = rows.select("own", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[] if t is None else t.encode().split() for t in batch.column(0).to_pylist()]  # bytes are split at ASCII blanks only
            at = 0
            while at < len(words):
                to, size = at, 0
                while to < len(words) and (to == at or size + len(words[to]) <= AT_ONCE):
                    size += len(words[to])
                    to += 1
                found = runs_of_texts(words[at:to], least, repeats)
                columns = [
                    pa.array([len(w) for w in words[at:to]], pa.int64()),
                    pa.array([[{"start": a, "length": b, "period": c} for a, b, c in r] for r in found], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                    pa.array([collapse(w, r).decode() for w, r in zip(words[at:to], found, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, to - at), *columns], ["own", "n_words", "runs", "collapsed"])
                at = to

    return rows.mapInArrow(search, out).select(*kept, "n_words", "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one in ten doc_ids a text whose words from some place on repeat the first ones from there: what the query is asked about."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_word_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs, planted(F.col("doc_id"), F.col("text")), ["doc_id"])

    def by_exponent(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left > right, -1).when(left < right, 1).otherwise(F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"]))).cast("int")

    top = F.get(F.array_sort("runs", by_exponent), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]), ","), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
