"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals make a document's score.

Fitting takes a bounded sample of labelled documents. Words and word beginnings that toxic documents hold far more
often than others label the tokens of toxic documents; on these labels the field is fitted: weights of a token's
features (the word, its first 3 to 6 characters, its last 3) and of the steps between the states clean and toxic. Forward and backward
messages, as log ratios of the two states, give each token's marginal in whole texts; a logistic
function of a text's largest marginal and expected number of toxic tokens is its score. Offending offsets are runs of
tokens whose marginal is 0.5 or more.

Nulls, ties, empty inputs: null and wordless texts get the score of a text without toxic tokens and no spans; rows that
repeat are judged alike; null doc_ids and labels are not learned from; without labels of both kinds all
scores are 0; an empty table gives an empty result. Other columns are kept as they are,
but score and spans are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.llm.langid import held_out
from quarrylog.llm.shared import bounded_batches, labelled_sample, spot, stash

#: Bytes that don't belong to words become blanks; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower()
    return [f"w={w}", *(f"b{n}={w[:n]}" for n in (3, 4, 5, 6) if len(w) > n), *([f"e3={w[-3:]}"] if len(w) > 3 else [])]


class Field:
    """weights of features, a bias, and the log weights of steps from one state to the next; states: 0 clean, 1 toxic."""

    def __init__(self, weights: dict[str, float], bias: float, steps: np.ndarray, logistic: np.ndarray):
        self.weights, self.bias, self.steps, self.logistic = weights, bias, steps, logistic

    def emissions(self, words: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        def look(w: bytes) -> float:
            e = known.get(w)
            if e is None:
                if len(known) > 100_000:
                    known.clear()
                e = known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
            return e

        return np.fromiter(map(look, words), float, len(words))


def log_ratio(x: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """log((s01 + s11 e^x) / (s00 + s10 e^x)) for log steps s: what a message with ratio x says about the next state."""
    return np.logaddexp(steps[0, 1], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[1, 0] + x)


def laid(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the stretches of at most block tokens that texts, one after another, are cut into."""
    count = np.maximum(1, -(-lengths // block))
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(lengths) - lengths)[text] + nth * block, np.minimum(block, lengths[text] - nth * block), text


def side_by_side(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place t: the stretches that are longer than t, and their t-th tokens."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for t, k in enumerate(active):
        yield order[:k], starts[:k] + t


def messages(e: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = 512) -> np.ndarray:
    """r[t] = e[t] + log_ratio(r[t - 1]) within each text, the first r being e. Texts advance side by side, and so do the stretches of a long text.

    A stretch turns the ratio that enters it into the one that leaves it by a 2 x 2 matrix of logs, the product of its
    tokens' matrices; those of all stretches are made together, then the stretches' entries one after another.
    """
    starts, n, text = laid(lengths, block)
    enters = np.full(len(starts), np.nan)  # none enters a text's first stretch
    later = np.append(False, text[1:] == text[:-1]) if len(text) else np.empty(0, bool)
    if later.any():
        m = np.zeros((len(starts), 2, 2))
        m[:, 0, 1] = m[:, 1, 0] = -np.inf
        inner = np.flatnonzero(np.append(later[1:], False))  # stretches that another one of the text follows
        for t, (own, at) in enumerate(side_by_side(starts[inner], n[inner])):
            k = inner[own]
            clean = np.logaddexp(steps[0, 0] + m[k, 0], steps[1, 0] + m[k, 1])
            toxic = np.logaddexp(steps[0, 1] + m[k, 0], steps[1, 1] + m[k, 1]) + e[at][:, None]
            top = np.maximum(clean.max(1), toxic.max(1))[:, None]
            m[k, 0], m[k, 1] = clean - top, toxic - top
            if t == 0:  # a text's first token has no step before it
                first = ~later[k]
                m[k[first], 0], m[k[first], 1] = [0.0, -np.inf], np.stack([e[at[first]], np.full(first.sum(), -np.inf)], 1)
        for i in np.flatnonzero(later):
            x = enters[i - 1] if later[i - 1] else 0.0
            enters[i] = np.logaddexp(m[i - 1, 1, 0], m[i - 1, 1, 1] + x) - np.logaddexp(m[i - 1, 0, 0], m[i - 1, 0, 1] + x)
    out = np.empty_like(e)
    for t, (own, at) in enumerate(side_by_side(starts, n)):
        if t:
            out[at] = e[at] + log_ratio(out[at - 1], steps)
        else:
            first = np.isnan(enters[own])
            out[at] = e[at] + np.where(first, 0.0, log_ratio(np.where(first, 0.0, enters[own]), steps))
    return out


def marginals(e: np.ndarray, lengths: np.ndarray, steps: np.ndarray, block: int = 512) -> np.ndarray:
    """Log ratios of the marginals of all tokens of several texts, one after another in e."""
    behind = messages(e[::-1], lengths[::-1], steps.T, block)[::-1]
    return messages(e, lengths, steps, block) + behind - e


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def document_features(m: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """1, the log ratio of the largest marginal, and the log of 1 + the expected number of toxic tokens, of each text."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    top, sums = np.full(len(lengths), -12.0), np.bincount(owner, sigmoid(m), len(lengths))
    np.maximum.at(top, owner, m)
    return np.stack([np.ones(len(lengths)), np.clip(top, -12, 12) / 4, np.log1p(sums)], 1)


def train(docs: DataFrame, labels: DataFrame, each: int = 1200) -> Field | None:
    """docs (doc_id, text) and labels (doc_id, toxic) that it may learn from: about each documents of either label, whole, with all their words.

    Of rows that share a doc_id the first text in order is learned, so that the bound holds for rows.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.broadcast(stash(labelled_sample(marks, "toxic", each, 3 * each, "doc_id"), "toxic-sample"))  # labels are drawn, then their texts are read
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    ids: dict[bytes, int] = {b"": 0}
    texts, y = [], []
    for r in stash(rows, "toxic-texts").orderBy("doc_id").toLocalIterator():  # here a text is a few bytes a word
        texts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(r["text"])), np.int32))
        y.append(float(r["toxic"] == 1))
    if not 0 < sum(y) < len(y):
        return None
    return fit(list(ids), texts, np.array(y))


def fit(words: list[bytes], texts: list[np.ndarray], y: np.ndarray, passes: int = 8, piece: int = 256, at_once: int = 65_536, prior: float = 0.2, least: int = 5) -> Field:
    """words, and texts as numbers of words. All tokens are used, a stretch of pieces at a time: weights move after each, in several passes."""
    known = [features(w) for w in words]
    whole = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    toxic = np.repeat(y, whole) == 1
    starts, ends = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    full = whole[whole > 0]
    starts[np.cumsum(full) - full], ends[np.cumsum(full) - 1] = True, True
    before, after = np.where(starts, 0, np.roll(flat, 1)), np.where(ends, 0, np.roll(flat, -1))
    # a word counts once for each text and for each pair of neighbours, whichever are fewer: neither a text that repeats a
    # word nor copies of a text add up
    n, owner = len(words), np.repeat(np.arange(len(whole)), whole)
    held = [Counter(), Counter()]
    for own, h in zip((~toxic, toxic), held, strict=True):
        around = before[own] * n + after[own]
        if n**3 >= 1 << 63:  # so many words that triples of them don't fit in 64 bits: the neighbours get numbers
            around = np.unique(around, return_inverse=True)[1]
        beside = int(around.max(initial=0)) + 1
        places = np.unique(flat[own] * beside + around) // beside
        holders = np.unique(owner[own] * n + flat[own]) % n
        c = np.minimum(np.bincount(places, minlength=n), np.bincount(holders, minlength=n))
        for i in np.flatnonzero(c):
            for f in known[i]:
                h[f] += int(c[i])
    del starts, ends, before, after, owner
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = {f: np.log((c + 0.5) / (n1 + 1)) - np.log((held[0][f] + 0.5) / (n0 + 1)) for f, c in held[1].items() if c >= least}
    # what the odds are at least, as far as chance goes: by two deviations fewer toxic texts and three clean ones more
    surely = {f: np.log((c - 2 * np.sqrt(c) + 0.5) / (n1 + 1)) - np.log((held[0][f] + 3) / (n0 + 1)) for f in odds if (c := held[1][f])}
    chosen = sorted(f for f in odds if abs(odds[f]) >= 0.7)
    index = {f: i + 1 for i, f in enumerate(chosen)}
    slots = max(map(len, known))
    table = np.array([([index.get(f, 0) for f in fs] + [0] * slots)[:slots] for fs in known], np.int32)
    sure = np.array([max((surely.get(f, 0.0) for f in fs), default=0.0) >= 1.5 for fs in known])
    z = toxic & sure[flat]
    at, lengths, _ = laid(whole, piece)
    some = np.random.default_rng(5).permutation(np.flatnonzero(lengths > 0))
    stretches = np.split(some, np.flatnonzero(np.diff(np.cumsum(lengths[some]) // at_once)) + 1)
    weights, bias, steps = np.zeros(len(chosen) + 1), -3.0, np.zeros((2, 2))
    squares, sb, ss = np.full(len(weights), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(passes):
        for own in stretches:
            k = lengths[own]
            spots = np.repeat(at[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            x, gold = table[flat[spots]], z[spots].astype(float)
            e = bias + weights[x].sum(1)
            m = marginals(e, k, steps)
            gap = gold - sigmoid(m)
            grad = np.bincount(x.ravel(), np.repeat(gap, slots), len(weights)) - 0.05 * weights / len(stretches)
            grad[0] = 0
            inner = np.ones(len(spots), bool)
            inner[np.cumsum(k) - k] = False
            inner = np.flatnonzero(inner)
            # expected steps: pairs of neighbouring states, by the joint of the messages from both sides
            joint = pairs(e, m, k, steps, inner)
            stood = np.array([[((1 - gold[inner - 1]) * (1 - gold[inner])).sum(), ((1 - gold[inner - 1]) * gold[inner]).sum()], [(gold[inner - 1] * (1 - gold[inner])).sum(), (gold[inner - 1] * gold[inner]).sum()]])
            gs = stood - joint - 0.05 * steps / len(stretches)
            squares, sb, ss = squares + grad**2, sb + gap.sum() ** 2, ss + gs**2
            weights, bias, steps = weights + 0.6 * grad / np.sqrt(squares), bias + 0.6 * gap.sum() / np.sqrt(sb), steps + 0.3 * gs / np.sqrt(ss)
    every = weights[table].sum(1)
    d = []
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(whole) // (8 * at_once))) + 1):
        words_here = np.concatenate([texts[i] for i in own])
        d.append(document_features(marginals(bias + every[words_here], whole[own], steps), whole[own]))
    d = np.concatenate(d)
    c = np.zeros(3)
    balance = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
    for _ in range(1500):  # Newton's method would do; plain steps on three weights are enough
        c += 4.0 * (d * ((y - sigmoid(d @ c)) * balance)[:, None]).sum(0) - 1e-4 * c
    return Field({f: float(weights[i]) for f, i in index.items() if weights[i]}, float(bias), steps, c)


def pairs(e: np.ndarray, m: np.ndarray, lengths: np.ndarray, steps: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected numbers of the four steps. For the token before: its messages from the left; for the token: all but the step."""
    ahead = messages(e, lengths, steps)
    right = m[inner] - log_ratio(ahead[inner - 1], steps)  # emission and what comes from the right
    left = ahead[inner - 1]
    logs = np.stack([np.full(len(inner), steps[0, 0]), steps[0, 1] + right, steps[1, 0] + left, steps[1, 1] + left + right])
    logs -= logs.max(0)
    q = np.exp(logs)
    return (q / q.sum(0)).sum(1).reshape(2, 2)


def spans_of(text: str, m: np.ndarray) -> list[dict]:
    """Runs of words whose marginal is 0.5 or more, as character offsets."""
    out: list[dict] = []
    last = -2
    for i, word in enumerate(WORD.finditer(text)):
        if m[i] >= 0:
            p = float(sigmoid(m[i]))
            if last == i - 1:
                out[-1] |= {"end": word.end(), "probability": max(out[-1]["probability"], p)}
            else:
                out.append({"start": word.start(), "end": word.end(), "probability": p})
            last = i
    return out


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs -> all their columns with score and spans (start, end, probability) of offending words."""
    docs = docs.drop(*("score", "spans"))
    names = docs.columns
    bounded_batches(docs.sparkSession, 4 << 20)
    kinds = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    if field is None:
        return docs.withColumns({"score": F.lit(0.0), "spans": F.array().cast(SPANS)})
    where = spot(names, "text")
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            texts = batch.column(where).to_pylist()
            scores, spans, at = np.zeros(len(texts)), [[]] * len(texts), 0
            while at < len(texts):
                own, tokens = [], 0
                while at + len(own) < len(texts) and (tokens < 200_000 or not own):
                    own.append(field.emissions(words_of(texts[at + len(own)]), known))
                    tokens += len(own[-1])
                lengths = np.array([len(x) for x in own], np.int64)
                m = marginals(np.concatenate(own), lengths, field.steps)
                d = document_features(m, lengths)
                scores[at : at + len(own)] = sigmoid(d @ field.logistic)
                ends = np.cumsum(lengths)
                for k in np.flatnonzero(d[:, 1] >= 0):
                    spans[at + k] = spans_of(texts[at + k], m[ends[k] - lengths[k] : ends[k]])
                at += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(spans, arrow)], [*names, "score", "spans"])

    return docs.mapInArrow(judge, kinds)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learned = ~held_out(F.col("doc_id"), 3, 1)
    field = train(docs.where(learned), labels.where(learned))
    rows = tag(docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out")), field)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
