"""Language ID: a byte convolutional network (filters of several widths, max pooling, softmax) fitted in numpy.

Fitting takes a bounded sample of labelled windows of whole texts. Texts, whole, are cut into windows of fixed length; windows of many texts
go through the network together, and a text's language has the highest mean probability over its windows, weighted
by their bytes. The network, some 100 kB, goes to the executors with the task.

Nulls, ties, empty inputs: null texts and texts without a letter are "und" with score 0; of equal probabilities the first
language in order wins; rows that repeat are judged alike; a null doc_id is neither learned from nor held out; without any
labelled row all texts are "und"; an empty table gives an empty result. Other columns are kept as they are, but lang_pred and score
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.llm.shared import bounded_batches, labelled_sample, spot

WIDTHS = (2, 3, 4)
FILTERS, DEPTH, WINDOW = 12, 8, 256
#: Bytes as the network sees them: A-Z as a-z, other ASCII than letters as a blank.
SEEN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def windows(text: bytes, length: int = WINDOW) -> np.ndarray:
    """A text's windows, the last filled up with 0, which is a byte without weight."""
    text = text.translate(SEEN)
    n = max(1, -(-len(text) // length))
    return np.frombuffer(text.ljust(n * length, b"\0"), np.uint8).reshape(n, length)


class ByteNetwork:
    """Embedding of bytes, filters of widths 2 to 4 as one matrix over 4 bytes, maximum over positions, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, k = max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((wide, DEPTH, k), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {"bytes": rng.normal(0, 0.5, (256, DEPTH)), "filters": rng.normal(0, 0.3, (wide, DEPTH, k)), "shift": np.zeros(k), "dense": rng.normal(0, 0.3, (k, len(languages))), "bias": np.zeros(len(languages))}
        self.p = {name: v.astype(np.float32) for name, v in self.p.items()}
        self.p["bytes"][0] = 0
        self.p["filters"] *= self.mask

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        wide, (n, length) = max(WIDTHS), x.shape
        e = self.p["bytes"][x]
        seen = np.lib.stride_tricks.sliding_window_view(e, wide, axis=1).transpose(0, 1, 3, 2).reshape(n, length - wide + 1, wide * DEPTH)
        response = seen @ self.p["filters"].reshape(wide * DEPTH, -1)
        pooled = response.max(1)
        z = np.maximum(pooled + self.p["shift"], 0) @ self.p["dense"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), pooled, response, seen

    def gradients(self, xs: np.ndarray, ys: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of windows; they go to the positions that won the pooling."""
        wide, k = max(WIDTHS), FILTERS * len(WIDTHS)
        prob, pooled, response, seen = self.forward(xs)
        n, won = len(xs), response.argmax(1)
        dz = prob.copy()
        dz[np.arange(n), ys] -= 1
        dz /= n
        act = np.maximum(pooled + self.p["shift"], 0)
        dpool = (dz @ self.p["dense"].T) * (act > 0)
        picked = seen[np.arange(n)[:, None], won]  # text, filter, bytes * depth
        g = {"dense": act.T @ dz, "bias": dz.sum(0), "shift": dpool.sum(0), "filters": np.einsum("nk,nkd->dk", dpool, picked).reshape(wide, DEPTH, k) * self.mask}
        back = np.einsum("nk,wdk->nkwd", dpool, self.p["filters"])
        which = xs[np.arange(n)[:, None, None], won[:, :, None] + np.arange(wide)]
        g["bytes"] = np.zeros_like(self.p["bytes"])
        np.add.at(g["bytes"], which.reshape(-1), back.reshape(-1, DEPTH))
        g["bytes"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross-entropy of single windows."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                step += 1
                for name, grad in self.gradients(x[order[at : at + batch]], y[order[at : at + batch]]).items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad * grad
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def judge(self, texts: list[bytes], at_once: int = 128) -> np.ndarray:
        """Mean probabilities of each text's languages. What a pass of at_once windows makes, some 10 MB, is the worker's largest piece of memory."""
        out, weight = np.zeros((len(texts), len(self.languages))), np.array([max(len(t), 1) for t in texts], float)
        own, rows, size = [], [], 0

        def flush() -> None:
            if rows:
                x = np.concatenate(rows)
                prob = np.concatenate([self.forward(x[i : i + at_once])[0] for i in range(0, len(x), at_once)])
                filled = np.maximum((x != 0).sum(1), 1)
                np.add.at(out, np.repeat([i for i, _ in own], [n for _, n in own]), prob * filled[:, None])
                own.clear(), rows.clear()

        for i, text in enumerate(texts):
            w = windows(text)
            own.append((i, len(w)))
            rows.append(w)
            size += len(w)
            if size >= 32 * at_once:
                flush()
                size = 0
        flush()
        return out / weight[:, None]


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, each: int = 2400, most: int = 48_000) -> ByteNetwork | None:
    """Fits on about each windows of every language, most in all but one at least of each; docs (doc_id, text, lang) are those it may learn from.

    The labelled rows that are drawn are distinct windows of whole texts, all alike, so neither long texts nor their ends are left
    out. They are cut and drawn by a hash of their bytes where the texts are; only drawn ones come to the driver.
    """
    rows = docs.where("doc_id is not null and lang is not null and text rlike '\\\\p{L}'").select("lang", F.encode("text", "UTF-8").alias("bytes"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("bytes") - 1) / WINDOW).cast("int")), lambda i: F.substring("bytes", i * WINDOW + 1, F.lit(WINDOW)))
    pieces = rows.select("lang", cut.alias("cut")).select("lang", F.explode_outer("cut").alias("piece"))
    drawn = labelled_sample(pieces, "lang", each, most, "piece").orderBy("lang", "piece").collect()
    if not drawn:
        return None
    network = ByteNetwork(sorted({r["lang"] for r in drawn}))
    number = {lang: i for i, lang in enumerate(network.languages)}
    x, y = np.concatenate([windows(bytes(r["piece"])) for r in drawn]), np.array([number[r["lang"]] for r in drawn])
    n = np.bincount(y).max()
    alike = np.concatenate([np.resize(np.flatnonzero(y == k), n) for k in number.values()])  # a language of few windows is shown as often as the others
    network.fit(x[alike], y[alike])
    return network


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """docs -> all their columns with lang_pred and score."""
    docs = docs.drop(*("lang_pred", "score"))
    names = docs.columns
    bounded_batches(docs.sparkSession, 4 << 20)
    if network is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    where = spot(names, "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if some:
                prob = network.judge([texts[i].encode() for i in some])
                best = prob.argmax(1)
                for i, b, p in zip(some, best, prob[np.arange(len(some)), best], strict=True):
                    lang[i], score[i] = network.languages[b], min(1.0, float(p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    out = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(judge, out)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return identify(rows, network).drop("text")
