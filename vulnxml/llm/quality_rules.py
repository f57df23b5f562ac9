"""Quality rules: counts with fixed limits, then a calibrated logistic model.

Words are runs of bytes other than space, \\t \\n \\v \\f \\r. The rules count
words, their code points, symbols, repeated lines and words inside repeated
8-word windows (found by 64-bit hashes, then compared as text). The verdict of
a text that passes them is a logistic regression on hashed words and byte
trigrams, trained on labelled rows (at most about ``SAMPLE`` of each label,
chosen by a hash of the id) and calibrated on a fifth of them that the weights
haven't seen; it is kept at a probability of ``KEEP`` or more. Scoring runs in
Arrow batches over whole texts.

Null texts have no words: they fail the rules. Without labelled rows of both
kinds the rules alone decide. Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import unit_hash
from vulnxml.llm.linear import fit_logistic, fit_platt, sigmoid
from vulnxml.llm.textfeat import WordHasher, trigram_buckets, utf8, word_buckets

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, KEEP = 8, 20, 30, 0.3
SYMBOLS = "#*$%&|<>"
WORD_BITS, GRAM_BITS, SAMPLE = 12, 11, 1500


def repeated_words(b: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first one included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    raw, hit, group = b.tobytes(), np.zeros(n, bool), {}
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    # equal hashes are compared as words
    at = order[twice].tolist()
    words = {}
    for i in at:
        for j in range(i, i + window):
            if j not in words:
                words[j] = raw[starts[j]:ends[j]]
    for i in at:
        group.setdefault(tuple(words[j] for j in range(i, i + window)), []).append(i)
    for members in group.values():
        if len(members) > 1:
            hit[members] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


class Reader:
    """Counts and features of texts."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def __call__(self, text: str | None) -> tuple[list[int], np.ndarray]:
        text = text or ""
        b = utf8(text)
        h, starts, ends = self.hasher(b)
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        rules = [len(h), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(b, h, starts, ends)]
        v = np.concatenate([np.bincount(word_buckets(h, WORD_BITS), minlength=1 << WORD_BITS),
                            np.bincount(trigram_buckets(b, GRAM_BITS), minlength=1 << GRAM_BITS)]).astype(np.float32)
        for part in (v[:1 << WORD_BITS], v[1 << WORD_BITS:]):
            np.log1p(part, out=part)
            part /= max(float(np.linalg.norm(part)), 1e-9) * 2 ** 0.5
        return rules, v


def base_failed(rules: list[int]) -> bool:
    return rules[0] < MIN_WORDS or 100 * rules[4] > MAX_REPEAT_PERCENT * rules[0]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, v: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.slope * (v @ self.weights + self.bias) + self.shift)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): at most about ``bound`` rows of each label, chosen by a
    hash of the id before the texts are read."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, min(1.0, bound / n)).otherwise(share)
    chosen = known.where(unit_hash("id", seed=11) < share)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [read(t.as_py())[1].astype(np.float16).tobytes() for t in batch.column(2)], pa.binary())], ["id", "y", "v"])

    sample = labelled_sample(docs, labels, label_col, SAMPLE, id_col, text_col)
    rows = sample.select(F.col("id").cast("string").alias("id"), "y", "text").mapInArrow(each, "id string, y int, v binary").collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["y"], bytes(r["v"])))
    y = np.array([r["y"] for r in rows], np.float32)
    if len(rows) < 10 or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32)
    del rows
    aside = np.arange(len(y)) % 5 == 0
    if y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    w, b = fit_logistic(x[~aside], y[~aside])
    held = aside if aside.any() else ~aside
    slope, shift = fit_platt((x[held] @ w + b).astype(np.float64), y[held])
    return Model(w, b, slope, shift)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the five counts, base_failed, probability, kept."""
    model = fit(docs, labels, "quality", id_col, text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            rules, failed, prob = [], [], []
            for t in batch.column(1):
                r, v = read(t.as_py())
                rules.append(r)
                failed.append(base_failed(r))
                prob.append(model.probability(v) if model else 1.0)
            cols = [pa.array([r[i] for r in rules], pa.int64()) for i in range(5)]
            kept = [not f and p >= KEEP for f, p in zip(failed, prob)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(prob, pa.float64()), pa.array(kept, pa.bool_())],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(each, "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean")
    return out.withColumnRenamed("id", id_col)
