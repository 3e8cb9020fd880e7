"""Cross-tokenizer alignment: which tokens of a byte-level tokenizer (A) lie over which of a piece tokenizer (B), and how often in the corpus.

A text with a blank before it is encoded by both; byte offsets where tokens of both end cut them into groups, and tokens that share bytes are
linked. The first pass counts, in each task, how many of its documents hold each linked pair of ids. Distinct pairs get numbers by minimal perfect
hashes (bit levels, one hash for each segment of the pairs' hash space), with the pairs kept in the order of their numbers, so that
every lookup is verified. The tasks' counts become dense vectors indexed by these numbers, and the vectors are summed up as a tree.
The second pass aligns the documents again and looks the counts up: in tables that each task reads from the shared folder while there are at most
MOST_PAIRS pairs (some 25 bytes each), else by a join with the pairs of each document.

Neither tokenizer has a token across a single blank between two other characters (it is looked up in their vocabularies), so a text is a
sequence of words with a blank before each, and a task encodes and aligns each distinct word once, many at a time; where tokenizers lack that property, and for
texts with a word that can't be aligned alone, the whole text is aligned. Both ways give the same tokens.

Nulls, ties, empty inputs: null and empty texts, and texts whose tokens' bytes differ from the text's, have no tokens: all numbers are 0 and groups is '';
rows that repeat are documents of their own; of equal counts all are best; very long texts are aligned whole; an empty table gives an
empty result. Other columns, whatever their names, are kept as they are, but those of the result's names are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.shared import bounded_batches, packed, scratch, stash
from quarrylog.llm.warc import file_system
from quarrylog.sources.scratch import add

#: Ids are below 2 ** WIDE; a pair is a * 2 ** WIDE + b.
WIDE = 20
MOST_PAIRS = 8_000_000
#: Parts of the hash space that segments are made of, pairs in a segment on average, and rows of counts for one dense vector.
SLICES, SEGMENT, ROWS = 4096, 1 << 16, 1 << 20
#: Distinct words that a task remembers, and characters that are encoded at once.
REMEMBERED, CHUNK = 400_000, 1 << 17
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
WHITE_PAIR = re.compile(r"\s\s")
BETWEEN = re.compile(r"(?<=\S)(?= \S)")
#: Fixed: how byte-level tokenizers of this kind cut a text before they merge.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that all versions of Unicode's tables class alike: Latin, Cyrillic, kana, Han, Hangul, usual marks.
STEADY = re.compile("[\x00-\u02af\u0400-\u0481\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those from first[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Aligner:
    """Both tokenizers, and the alignment of the words met so far.

    Of word w: stats[:, w] its numbers of A and B tokens, groups and links, and whether it can be aligned; links[first[w] : first[w] + stats[3, w]] its pairs.
    """

    def __init__(self, a: bytes, b: bytes, with_groups: bool):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary, n = byte_alphabet(), self.a.get_vocab(), self.b.get_piece_size()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), n) > 1 << WIDE:
            raise ValueError(f"a vocabulary has more than {1 << WIDE} ids")
        self.length_a, self.length_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        kind, model = json.loads(a), sentencepiece_model_pb2.ModelProto.FromString(b)
        regular = kind.get("normalizer") is None and (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and kind["pre_tokenizer"].get("use_regex", True)
        plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.by_word = bool(regular and plain and not any("▁" in p.lstrip("▁") for p in pieces))
        self.quick = self.by_ranks(kind, vocabulary) if regular else None
        self.spelled = [np.array([f"{i}{mark}" for i in range(k)], object) for k, marks in ((len(self.bytes_a), ",|"), (n, ",;")) for mark in marks] if with_groups else None
        self.forget()

    def by_ranks(self, kind: dict, vocabulary: dict[str, int]):
        """The same merges as ids for a faster encoder, if every merge's id is above those of the merges before; else None. It agrees on steady characters."""
        from tiktoken import Encoding

        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in kind["model"].get("merges", [])]
        if kind["model"].get("type") != "BPE" or kind["model"].get("ignore_merges") or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        special = {t["id"] for t in kind.get("added_tokens", [])}
        ranks = {t: i for i, t in enumerate(self.bytes_a) if i not in special}
        return Encoding("a", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(merged) + 256 else None

    def encode_a(self, text: str) -> list[int]:
        return self.quick.encode_ordinary(text) if self.quick and STEADY.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.number = Numbers()
        self.stats, self.first, self.links = np.zeros((5, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups: list[str] = []

    def words(self, text: str) -> list[str]:
        """The text cut at single blanks between other characters."""
        if not self.by_word:
            return [text]
        if not (text[0].isspace() or text[-1].isspace() or WHITE_PAIR.search(text)):
            return text.split(" ")
        return [w[1:] for w in BETWEEN.split(" " + text)]

    def see(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of these texts, one text after another, and how many each text has."""
        number = self.number
        of = [[number[w] for w in self.words(t)] if t else [] for t in texts]
        self.align_new()
        odd = np.flatnonzero(self.stats[4] == 0)
        if len(odd):
            odd = set(odd.tolist())
            of = [[number[t]] if len(w) > 1 and not odd.isdisjoint(w) else w for t, w in zip(texts, of, strict=True)]
            self.align_new()
        lengths = np.array([len(x) for x in of], np.int64)
        return np.fromiter(chain.from_iterable(of), np.int64, int(lengths.sum())), lengths

    def align_new(self) -> None:
        new = list(islice(self.number, self.stats.shape[1], None))
        edged = [w[0].isspace() or w[-1].isspace() for w in new]  # these could grow into their neighbours
        steady = [STEADY.fullmatch(w) is not None for w in new]
        parts, at = [], 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) < CHUNK and not edged[at] and not edged[to] and steady[to] == steady[at]):
                size += len(new[to]) + 1
                to += 1
            parts += self.align([" " + w for w in new[at:to]])
            at = to
        if parts:
            stats, links, groups = zip(*parts, strict=True)
            self.stats = np.concatenate([self.stats, *stats], axis=1)
            self.links = np.concatenate([self.links, *links])
            self.first = np.cumsum(self.stats[3]) - self.stats[3]
            self.groups += [g for x in groups for g in x]

    def align(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        """stats, links and groups of words, encoded together if that is sure to give the same as one by one."""
        text = "".join(words)
        raw = text.encode()
        a, b = self.encode_a(text), self.b.encode(text[1:])
        same = b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])
        if not same and len(words) > 1:
            return [x for w in words for x in self.align([w])]
        if not same:
            return [(np.zeros((5, 1), np.int64), np.zeros(0, np.int64), [""])]
        a, b = np.array(a), np.array(b)
        end_a, end_b, ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum([len(w) for w in words] if len(raw) == len(text) else [len(w.encode()) for w in words])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        if len(words) > 1 and not np.isin(ends, cuts, assume_unique=True).all():
            return [x for w in words for x in self.align([w])]
        low = np.searchsorted(end_b, end_a - self.length_a[a], side="right")
        n = np.searchsorted(end_b - self.length_b[b], end_a, side="left") - low
        word_a = np.searchsorted(ends, end_a)
        stats = np.stack([np.bincount(word_a, minlength=len(words)), np.bincount(np.searchsorted(ends, end_b), minlength=len(words)), np.bincount(np.searchsorted(ends, cuts), minlength=len(words)), np.bincount(word_a, n, len(words)).astype(np.int64), np.ones(len(words), np.int64)])
        links = (np.repeat(a, n) << WIDE) | b[ranges(low, n)]
        return [(stats, links, self.spell(a, b, end_a, end_b, cuts, stats))]

    def spell(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, cuts: np.ndarray, stats: np.ndarray) -> list[str]:
        """For each word its groups as a,a|b; one after another."""
        if self.spelled is None:
            return [""] * stats.shape[1]
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        a_comma, a_bar, b_comma, b_end = self.spelled
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(of_b, of_a, side="left")] = np.where(np.r_[of_a[1:] == of_a[:-1], False], a_comma[a], a_bar[a])
        out[np.arange(len(b)) + np.searchsorted(of_a, of_b, side="right")] = np.where(np.r_[of_b[1:] == of_b[:-1], False], b_comma[b], b_end[b])
        pieces, ends = out.tolist(), np.cumsum(stats[0] + stats[1]).tolist()
        return ["".join(pieces[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def hashed(pairs: np.ndarray, level: int) -> np.ndarray:
    """64-bit hashes of int64 numbers, other ones on each level."""
    x = pairs.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def perfect_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bits of a minimal perfect hash of distinct keys: on each level those keys are done that have a place of it for themselves."""
    levels: list[np.ndarray] = []
    while len(keys):
        size = max(64, 2 * len(keys))
        at = hashed(keys, len(levels)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at.astype(np.int64)]]
    return levels


class PerfectHash:
    """Numbers of keys by the bits of many segments: a key's segment, then the first level that has a bit at its place, then the bits before."""

    def __init__(self, segments: int, sizes: dict[int, list[int]], bits: dict[int, bytes]):
        self.segments, deepest = segments, max([1, *map(len, sizes.values())])
        self.size, self.base = np.zeros((segments, deepest), np.int64), np.zeros((segments, deepest), np.int64)
        parts, start = [np.zeros(1, bool)], 1
        for s in sorted(sizes):
            own = np.unpackbits(np.frombuffer(bits[s], np.uint8)).astype(bool)
            self.size[s, : len(sizes[s])] = sizes[s]
            self.base[s, : len(sizes[s])] = start + np.cumsum([0, *sizes[s][:-1]])
            parts.append(own[: sum(sizes[s])])
            start += sum(sizes[s])
        self.bits = np.concatenate(parts)
        self.before = np.cumsum(self.bits) - self.bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys that were hashed; any number for others."""
        segment, out, left = segment_of(keys, self.segments), np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            size = self.size[segment[left], level]
            left, size = left[size > 0], size[size > 0]
            at = self.base[segment[left], level] + (hashed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            out[left] = self.before[at]
            left = left[~self.bits[at]]
        return out


def slice_of(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, 63) % np.uint64(SLICES)).astype(np.int64)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return slice_of(keys) * segments // SLICES


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def partial_counts(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """docs (text) -> part, slice, pair, n: of how many documents a task has seen the pair linked; one row or more for a task and pair."""
    spark = docs.sparkSession
    bounded_batches(spark)
    models = spark.sparkContext.broadcast((a, b))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = Aligner(*models.value, False), TaskContext.get().partitionId()
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 100_000):
                p = pairs[i : i + 100_000]
                yield batch_of(part=np.full(len(p), part), slice=slice_of(p), pair=p, n=n[i : i + 100_000])

        for batch in batches:
            words, lengths = own.see(batch.column(0).to_pylist())
            width = max(1, own.stats.shape[1])
            doc, word = np.divmod(np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + words), width)
            k = own.stats[3, word]
            held = np.unique((np.repeat(doc, k) << 2 * WIDE) | own.links[ranges(own.first[word], k)]) & ((1 << 2 * WIDE) - 1)
            new, m = np.unique(held, return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(pairs)).astype(np.int64)
            if len(pairs) > 2 * REMEMBERED:
                yield from out()
                pairs, n = pairs[:0], n[:0]
            if len(own.number) > REMEMBERED:
                own.forget()
        yield from out()

    return docs.select("text").mapInArrow(count, "part long, slice long, pair long, n long")


def hash_pairs(partial: DataFrame, segments: int) -> DataFrame:
    """segment, sizes, bits, pairs: the perfect hash of each segment's distinct pairs, and these in the order of their numbers."""

    def build(table: pa.Table) -> pa.Table:
        pairs = table["pair"].to_numpy()
        levels = perfect_levels(pairs)
        number = PerfectHash(1, {0: [len(x) for x in levels]}, {0: np.packbits(np.concatenate(levels)).tobytes()})
        ordered = np.empty(len(pairs), np.int64)
        ordered[number(pairs)] = pairs
        return pa.table({"segment": [table["segment"][0].as_py()], "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), "bits": [np.packbits(np.concatenate(levels)).tobytes()], "pairs": [ordered.tobytes()]})

    distinct = partial.select(F.floor(F.col("slice") * segments / SLICES).alias("segment"), "pair").distinct()
    return distinct.groupBy("segment").applyInArrow(build, "segment long, sizes array<long>, bits binary, pairs binary")


def summed(partial: DataFrame, hashes: DataFrame, segments: int, rows: int) -> DataFrame:
    """segment, branch, counts: the sums of the tasks' counts as one dense vector for each segment.

    Some ROWS rows of counts make a vector, and each round adds eight vectors up, so no task holds more than that.
    """
    branches = max(1, -(-rows // (segments * ROWS)))
    spread = partial.select(F.floor(F.col("slice") * segments / SLICES).alias("segment"), F.pmod(F.xxhash64("part"), F.lit(branches)).alias("branch"), "pair", "n")
    keys = hashes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long"))).alias("branch"))
    schema = "segment long, branch long, counts binary"

    def dense(counts: pa.Table, keys: pa.Table) -> pa.Table:
        if not len(counts):
            return pa.table({"segment": pa.array([], pa.int64()), "branch": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        row = keys.to_pylist()[0]
        ordered, pairs = np.frombuffer(row["pairs"], np.int64), counts["pair"].to_numpy()
        at = PerfectHash(1, {0: row["sizes"]}, {0: row["bits"]})(pairs)
        if not (ordered[at] == pairs).all():
            raise RuntimeError("a pair of ids is not where its hash says")
        total = np.bincount(at, counts["n"].to_numpy(), len(ordered)).astype(np.int64)
        return pa.table({"segment": [row["segment"]], "branch": [row["branch"]], "counts": [total.tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"segment": [table["segment"][0].as_py()], "branch": [table["branch"][0].as_py()], "counts": [total.tobytes()]})

    vectors = spread.groupBy("segment", "branch").cogroup(keys.groupBy("segment", "branch")).applyInArrow(dense, schema)
    while branches > 1:
        branches = -(-branches // 8)
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / 8)).groupBy("segment", "branch").applyInArrow(added, schema)
    return vectors


class Counts:
    """The table of pairs as a task reads it: pairs, documents and whether they are their A id's most, by the numbers of the perfect hash."""

    def __init__(self, segments: int, hashes: str, counted: str):
        import pyarrow.dataset as ds

        read = lambda path, *names: (lambda fs, p: ds.dataset(p, filesystem=fs, format="parquet").to_table(columns=list(names)))(*file_system(path))
        rows = read(hashes, "segment", "sizes", "bits").to_pylist()
        self.number = PerfectHash(segments, {r["segment"]: r["sizes"] for r in rows}, {r["segment"]: r["bits"] for r in rows})
        table = read(counted, "pair", "docs", "best")
        pairs = table["pair"].to_numpy()
        at = self.number(pairs)
        self.pairs, self.docs, self.best = (np.zeros(len(pairs), kind) for kind in (np.int64, np.int64, bool))
        self.pairs[at], self.docs[at], self.best[at] = pairs, table["docs"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether they are best, their documents, and whether they are absent."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.ones(len(pairs), bool)
        at = self.number(pairs)
        there = self.pairs[at] == pairs
        return self.best[at] & there, self.docs[at] * there, ~there


def count_pairs(docs: DataFrame, a: bytes, b: bytes) -> tuple[DataFrame, int, int, str, str]:
    """The first pass: the table pair, a, b, docs, best, how many pairs and segments it has, and where the hashes and the table lie."""
    spark = docs.sparkSession
    partial = stash(partial_counts(docs, a, b), "pair-partial")
    n, rows = partial.select("pair").distinct().count(), partial.count()
    segments = min(SLICES, max(1, -(-n // SEGMENT)))
    at_hashes, at_counted = scratch(spark, "pair-hashes"), scratch(spark, "pair-counts")
    hashes = hash_pairs(partial, segments)
    add(hashes, at_hashes)
    hashes = spark.read.schema(hashes.schema).parquet(at_hashes)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                yield batch_of(pair=np.frombuffer(pairs, np.int64), docs=np.frombuffer(counts, np.int64))

    vectors = summed(partial, hashes, segments, rows)
    table = stash(hashes.join(vectors, "segment").select("pairs", "counts").mapInArrow(unfold, "pair long, docs long"), "pair-sums")
    table = table.withColumns({"a": F.shiftright("pair", WIDE), "b": F.col("pair").bitwiseAND((1 << WIDE) - 1)})
    most = table.groupBy("a").agg(F.max("docs").alias("most"))
    table = table.join(most, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
    add(table, at_counted)
    return spark.read.schema(table.schema).parquet(at_counted), n, segments, at_hashes, at_counted


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, keep: list[str] | None = None, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """docs (text and others) -> (alignments, pairs).

    alignments: the columns to keep, or all, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2`: ids in order). pairs: pair, a, b, docs,
    best: in how many documents the ids are linked, and whether that is the most for a. Files of vocabularies are read by the driver and go to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_a, "rb") as x, open(tokenizer_b, "rb") as y:
        a, b = x.read(), y.read()
    pairs, n, segments, at_hashes, at_counted = count_pairs(docs, a, b)
    own, kept = packed([c for c in (docs.columns if keep is None else keep) if c not in (*NUMBERS, "groups")])
    rows, here = docs.select("text", own), n <= most_pairs
    models = spark.sparkContext.broadcast((a, b))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = Aligner(*models.value, True), Counts(segments, at_hashes, at_counted) if here else None
        value = np.zeros((3, 0), np.int64)
        for batch in batches:
            words, lengths = aligner.see(batch.column(0).to_pylist())
            stats, new = aligner.stats, value.shape[1]
            if counts:
                found = counts(aligner.links[stats[3, :new].sum() :])
                word = np.repeat(np.arange(stats.shape[1] - new), stats[3, new:])
                value = np.concatenate([value, [np.bincount(word, x, stats.shape[1] - new).astype(np.int64) for x in found]], axis=1)
            ends = np.cumsum(lengths)
            every = np.concatenate([stats[:4], value if counts else np.zeros((3, stats.shape[1]), np.int64)])
            upto = np.concatenate([np.zeros((7, 1), np.int64), np.cumsum(every[:, words], axis=1)], axis=1)
            sums = upto[:, ends] - upto[:, ends - lengths]
            if sums[6].any():  # a word that no text is cut into may have pairs that are nowhere
                raise RuntimeError("a pair of ids is not in the table of counts")
            groups = aligner.groups
            at = 0
            while at < len(lengths):  # the spelled groups are longer than the texts
                to, size = at, 0
                while to < len(lengths) and (to == at or size + sums[0, to] + sums[1, to] < 400_000):
                    size += sums[0, to] + sums[1, to]
                    to += 1
                spelled = ["".join([groups[w] for w in words[ends[i] - lengths[i] : ends[i]].tolist()])[:-1] for i in range(at, to)]
                linked = {}
                if not counts:
                    each = [np.unique(aligner.links[ranges(aligner.first[w], stats[3, w])], return_counts=True) for w in (words[ends[i] - lengths[i] : ends[i]] for i in range(at, to))]
                    linked["linked"] = pa.array([[{"pair": int(p), "n": int(k)} for p, k in zip(*x, strict=True)] for x in each], pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))
                yield batch_of(own=batch.column(1).slice(at, to - at), **dict(zip(NUMBERS, sums[:6, at:to], strict=True)), groups=pa.array(spelled, pa.string()), **linked)
                at = to
            if len(aligner.number) > REMEMBERED:
                aligner.forget()
                value = value[:, :0]

    typed = {c: F.lit(0).cast("long") for c in NUMBERS} | {"groups": F.lit("")} | ({} if here else {"linked": F.lit(None).cast("array<struct<pair: long, n: long>>")})
    out = rows.mapInArrow(look_up, rows.select("own").withColumns(typed).schema)
    if not here:
        out = stash(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
        found = out.select("row", F.explode("linked").alias("l")).select("row", "l.*").join(pairs.select("pair", "docs", "best"), "pair")
        found = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("found_best"), F.sum(F.col("n") * F.col("docs")).alias("found_sum"))
        out = out.drop("n_best", "count_sum", "linked").join(found, "row", "left").withColumns({"n_best": F.coalesce("found_best", F.lit(0)), "count_sum": F.coalesce("found_sum", F.lit(0))})
    return out.select(*kept, *NUMBERS, "groups"), pairs


def op11_token_alignment(spark, sf_dir: str, folder: str = "/opt/tokenizers") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned, _ = align(docs, f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model", ["doc_id"])
    return aligned.select("doc_id", *NUMBERS, F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
