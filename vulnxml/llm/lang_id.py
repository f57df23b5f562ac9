"""Language ID by nearest centroid over TF-IDF byte trigrams.

Features: trigrams of the lower-cased UTF-8 text whose ASCII digits, signs and
white space are blanks, hashed to ``2**BITS`` buckets, log-scaled counts times
IDF, normalised. IDF comes from all training rows (a null language, or a held
out id, isn't one). Each language has up to ``K`` centroids, clustered by
cosine from at most about ``SAMPLE`` of its training rows (chosen by a hash of
the id, so re-runs agree). A text goes to the language of its nearest centroid;
its score is that cosine, floored at 0. It is *rejected* if the cosine is below
``SLACK`` times the least that sampled texts of its length class or longer ones
reach with their own language. Short texts are few, so the heads of sampled
texts (``HEADS`` characters, but for the oddest of them) count as texts too. Up to three characters hold
hardly a trigram: the least is 0 there, and nothing with a letter is rejected;
under 16 characters the least is small, and some texts of other languages pass.

Null texts and texts without a letter are ``und`` with score 0 and rejected; so
is every text if there is no training row. Whole texts are read, of any length.
Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import fresh_name, held_out, unit_hash
from vulnxml.llm.textfeat import trigram_buckets

BITS, K, SAMPLE, ROUNDS, SLACK = 12, 3, 400, 8, 0.5
#: The shortest texts of the classes under 64 characters.
HEADS = (1, 2, 4, 8, 16, 32)
#: This share of the heads of a class, cut within a word, number or list, may be under its floor.
ODD_HEADS = 0.02
UND = "und"
_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def counts(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK), np.uint8)
    return np.bincount(trigram_buckets(b, BITS), minlength=1 << BITS).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def length_class(text: str) -> int:
    return len(text).bit_length()


@dataclass
class Model:
    """What a prediction needs: a few hundred KB, whatever the corpus."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray  # least cosine by length class

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text) or not len(self.owner):
            return UND, 0.0, True
        cos = self.centroids @ self.vector(text)
        best = int(np.argmax(cos))
        score = min(max(float(cos[best]), 0.0), 1.0)
        return self.langs[self.owner[best]], score, score < float(self.floor[min(length_class(text), len(self.floor) - 1)])


def cluster(x: np.ndarray, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means. The first is the mean;
    each further one starts at the row least like those before."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.concatenate([c, x[[int(np.argmin((x @ c.T).max(axis=1)))]]])
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = unit(np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += counts(t.as_py()) > 0
                n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], ["bucket", "n"])

    # one row per bucket at most reaches the driver
    found = rows.select("text").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(1 << BITS), 0
    for r in found:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    model = Model(sorted(sizes), idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64), np.zeros(1))
    if not sizes:
        return model

    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE / n))])[F.col("lang")]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(g.as_py(), t.as_py()) for t, g in zip(batch.column(0), batch.column(1)) if has_letter(t.as_py())]
            yield pa.RecordBatch.from_arrays([
                pa.array([g for g, _ in keep], pa.string()),
                pa.array([model.vector(t).astype(np.float16).tobytes() for _, t in keep], pa.binary())], ["lang", "v"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = model.centroids[model.owner == model.langs.index(g)]
                for piece in [t, *(t[:n] for n in HEADS if n < len(t))]:
                    if has_letter(piece):
                        out.append((length_class(piece), len(piece) < len(t), max(0.0, float((own @ model.vector(piece)).max()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.bool_(), pa.float64()))], ["size", "head", "c"])

    chosen = rows.where(unit_hash("id") < share).select("text", "lang")
    sample = chosen.mapInArrow(vectors, "lang string, v binary")
    sample = sorted(sample.collect(), key=lambda r: (r["lang"], bytes(r["v"])))
    centroids, owner = [], []
    for i, lang in enumerate(model.langs):
        own = [r for r in sample if r["lang"] == lang]
        if not own:
            continue
        x = np.stack([np.frombuffer(r["v"], np.float16).astype(np.float32) for r in own])
        c = cluster(x)
        centroids.append(c)
        owner += [i] * len(c)
    if centroids:
        model.centroids, model.owner = np.concatenate(centroids).astype(np.float32), np.array(owner)
        found = chosen.mapInArrow(reached, "size bigint, head boolean, c double").groupBy("size")
        least = found.agg(F.least(F.min(F.when(~F.col("head"), F.col("c"))), F.percentile(F.when(F.col("head"), F.col("c")), F.lit(ODD_HEADS))).alias("c")).collect()
        least = {r["size"]: r["c"] for r in least}
        least = [least.get(size, 1.0) for size in range(max(least) + 1)]
        # a class may have few rows: no class asks for more than a longer one
        model.floor = SLACK * np.minimum.accumulate(np.array(least)[::-1])[::-1]
    return model


RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"


def predict(model: Model, text: str | Column) -> Column:
    """Struct (lang_pred, score, rejected) of a text column."""

    def each(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            rows = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                pa.array([r[2] for r in rows], pa.bool_())], ["lang_pred", "score", "rejected"])

    each.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, RESULT)(text)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected."""
    model = fit(docs, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), predict(model, F.col(text_col)).alias("p"))
    return out.select(F.col("id").alias(id_col), "held_out", "p.*")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is recognised, with their columns."""
    model, p = fit(docs, id_col, text_col, lang_col), fresh_name(docs, "language")
    return docs.withColumn(p, predict(model, F.col(text_col))).where(~F.col(f"{p}.rejected")).drop(p)
