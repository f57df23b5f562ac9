"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last may be shorter;
a text without a word has one empty passage). A passage is encoded from hashed
words, byte trigrams, byte classes and shares of repeated words by a trained
tanh layer; attention
weights softmax(w . (tanh(V h) * sigmoid(U h))) pool the encodings, and a
logistic unit scores the pooled vector. All weights are learned together from
document labels alone (Adam in numpy, at most about ``SAMPLE`` rows of each
label, none whose id is held out); the score is calibrated on a fifth of them
that the weights haven't seen. Passages of whole texts are scored, however
long, in blocks with a running softmax, so memory stays bounded.

Null texts count as empty and get a score too. Without labelled rows of both
kinds every score is 0.5. Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import held_out
from vulnxml.llm.linear import fit_platt, sigmoid
from vulnxml.llm.quality_rules import labelled_sample
from vulnxml.llm.textfeat import WordHasher, trigram_buckets, utf8, word_buckets

PASSAGE, BITS, HIDDEN, GATE, SAMPLE, EPOCHS, BATCH, RATE = 96, 8, 24, 12, 800, 12, 32, 0.01
THRESHOLD = 0.3
#: Passages encoded at once while scoring.
BLOCK = 512
#: Passages of one training document that are kept (evenly spread): bounds the fit.
TRAIN_PASSAGES = 64
WIDTH = 2 * (1 << BITS) + 16 + 3

_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = 1
for _i, _set in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&", "|<>", " ", "\n", "\t\r\v\f", "()[]{}", "\"'`", "_-+=/\\@~^"], 2):
    _CLASS[[ord(c) for c in _set]] = _i


class Passages:
    """Feature rows of a text's passages."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        b = utf8(text)
        h, starts, _ = self.hasher(b)
        if not len(h):
            yield np.zeros((1, WIDTH), np.float32)
            return
        cuts = np.append(starts[::PASSAGE], len(b))
        cuts[0] = 0
        for first in range(0, len(cuts) - 1, BLOCK):
            last = min(first + BLOCK, len(cuts) - 1)
            n, lo, hi = last - first, cuts[first], cuts[last]
            part, words = b[lo:hi], h[first * PASSAGE:last * PASSAGE]
            of_byte = np.repeat(np.arange(n), np.diff(cuts[first:last + 1]))
            of_word = np.arange(len(words)) // PASSAGE
            size = 1 << BITS
            grams = trigram_buckets(part, BITS)
            x = np.concatenate([
                np.bincount(of_word * size + word_buckets(words, BITS), minlength=n * size).reshape(n, size),
                np.bincount(of_byte[:len(grams)] * size + grams, minlength=n * size).reshape(n, size),
                np.bincount(of_byte * 16 + _CLASS[part], minlength=n * 16).reshape(n, 16)], axis=1).astype(np.float32)
            np.log1p(x, out=x)
            for a, z in ((0, size), (size, 2 * size), (2 * size, 2 * size + 16)):
                x[:, a:z] /= np.maximum(np.linalg.norm(x[:, a:z], axis=1, keepdims=True), 1e-6)
            full = np.full((n, 1), len(words) / (n * PASSAGE), np.float32)
            yield np.concatenate([x, self.variety(words, of_word, n), full], axis=1)

    @staticmethod
    def variety(words: np.ndarray, of_word: np.ndarray, n: int) -> np.ndarray:
        """Shares of different words and of words that repeat the one before."""
        total = np.bincount(of_word, minlength=n)
        order = np.lexsort((words, of_word))
        w, p = words[order], of_word[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1])))
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])))
        return np.stack([np.bincount(p[new], minlength=n) / total, np.bincount(of_word[again], minlength=n) / total], axis=1).astype(np.float32)


@dataclass
class Model:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, blocks: Iterator[np.ndarray]) -> float:
        """Of a bag given in blocks; the softmax is kept as running sums."""
        p, top, total, pooled = self.p, -np.inf, 0.0, 0.0
        for x in blocks:
            h = np.tanh(x @ p["E"] + p["e"])
            a = (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]
            new = max(top, float(a.max()))
            scale, ex = np.exp(top - new), np.exp(a - new)
            total, pooled, top = total * scale + ex.sum(), pooled * scale + ex @ h, new
        return float((pooled / total) @ p["c"] + p["b"])

    def score(self, blocks: Iterator[np.ndarray]) -> float:
        return float(sigmoid(np.float64(self.slope * self.logit(blocks) + self.shift)))


def start(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {"E": draw(WIDTH, HIDDEN) * 4, "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros((), np.float32)}


def gradients(p: dict[str, np.ndarray], bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss over some bags."""
    x = np.concatenate(bags)
    first = np.cumsum([0, *map(len, bags)])[:-1]
    bag = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    h = np.tanh(x @ p["E"] + p["e"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = (v * u) @ p["w"]
    ex = np.exp(a - np.maximum.reduceat(a, first)[bag])
    att = ex / np.add.reduceat(ex, first)[bag]
    z = np.add.reduceat(att[:, None] * h, first)
    dl = (weight * (sigmoid(z @ p["c"] + p["b"]) - y)).astype(np.float32)
    dz = dl[:, None] * p["c"]
    datt = (dz[bag] * h).sum(axis=1)
    da = att * (datt - np.add.reduceat(att * datt, first)[bag])
    dvu = da[:, None] * p["w"]
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh = (att[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "c": z.T @ dl, "b": dl.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> dict[str, np.ndarray]:
    p, r = start(seed), np.random.default_rng(seed)
    m, s, k = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
            g, k = gradients(p, [bags[i] for i in rows], y[rows], weight[rows] / len(rows)), k + 1
            for n in p:
                d = g[n] + 1e-4 * p[n]
                m[n], s[n] = 0.9 * m[n] + 0.1 * d, 0.999 * s[n] + 0.001 * d * d
                step = RATE * (1 - epoch / (epochs + 1)) * (m[n] / (1 - 0.9 ** k)) / (np.sqrt(s[n] / (1 - 0.999 ** k)) + 1e-8)
                p[n] = (p[n] - step).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Passages()
        for batch in batches:
            out = []
            for t in batch.column(2):
                x = np.concatenate(list(read(t.as_py())))
                if len(x) > TRAIN_PASSAGES:
                    x = x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]
                out.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "y", "v"])

    learn = labels.where(~held_out(id_col))
    sample = labelled_sample(docs, learn, label_col, SAMPLE, id_col, text_col)
    rows = sample.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(each, "id string, y int, v binary").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["y"], bytes(r["v"])))
    y = np.array([r["y"] for r in rows], np.float32)
    aside = np.arange(len(y)) % 5 == 0
    if len(rows) < 10 or y[~aside].min() == y[~aside].max():
        return None
    bags = [np.frombuffer(r["v"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    del rows
    model = Model(train([b for b, x in zip(bags, aside) if not x], y[~aside]))
    logits = np.array([model.logit(iter([b])) for b, x in zip(bags, aside) if x])
    model.slope, model.shift = fit_platt(logits, y[aside])
    return model


def scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = fit(docs, labels, label_col, id_col, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Passages()
        for batch in batches:
            out = np.array([model.score(read(t.as_py())) if model else 0.5 for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))],
                                             ["id", "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return src.mapInArrow(each, "id bigint, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
