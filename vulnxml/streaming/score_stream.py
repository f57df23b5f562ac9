"""Score new reports as they arrive (stateless Structured Streaming).

Reports stream in as files; each micro-batch is cleaned (P1), turned into a
hashed bag-of-words vector, scored against a label-sized weight matrix (R4)
and ranked (R3), all in one map stage: the weights are packed once, before the
stream starts, and sent to the tasks if they are under ``BROADCAST_BYTES``
(checked); a larger matrix is written in blocks once and meets the vectors in a
join. Every epoch is written to its own folder with overwrite, so a retried
epoch replaces its output instead of duplicating it. The batch path
(``score_batch``) is the same function, so stream output = batch output.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnxml.functions.text import basic_cleaning, words
from vulnxml.operators.labels import encode_labels
from vulnxml.operators.rank import predict_labels
from vulnxml.operators.vectors import SIM_DECIMALS, PackedKeys, best_columns, linear_scores, pack_weights, token_bucket
from vulnxml.session import write_and_read

DIM = 64
# Weights up to this size are sent to every executor.
BROADCAST_BYTES = 64 << 20


def _word_buckets(df: DataFrame, text_col: str, id_col: str, dim: int) -> DataFrame:
    buckets = F.transform(words(basic_cleaning(text_col)), lambda w: token_bucket(w, dim))
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(buckets, F.array().cast("array<int>")).alias("buckets"))


def _bags(buckets: pa.Array, dim: int) -> np.ndarray:
    """Unit-length counts of the buckets of each row."""
    flat = np.asarray(buckets.flatten().to_numpy(zero_copy_only=False), np.int64)
    row = np.repeat(np.arange(len(buckets)), np.diff(buckets.offsets.to_numpy()))
    x = np.bincount(row * dim + flat, minlength=len(buckets) * dim).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def text_vectors(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", dim: int = DIM) -> DataFrame:
    """(doc_id, vec): unit-length hashed bag of cleaned words (bucket = md5
    prefix of the word mod dim) of every row; a doc without words gets the zero
    vector. A map, no shuffle."""
    def each(batches):
        for b in batches:
            x = _bags(b.column(1), dim)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), vec], ["doc_id", "vec"])
    src = _word_buckets(df, text_col, id_col, dim)
    return src.mapInArrow(each, T.StructType([src.schema["doc_id"], T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def fit_centroids(docs: DataFrame, doc_labels: DataFrame, lmap: DataFrame, dim: int = DIM) -> DataFrame:
    """Weights of a nearest-centroid scorer: mean unit vector of each label's
    training docs -> (label_id, w, bias). Sums run per (label, dim)."""
    vec = text_vectors(docs, dim=dim)
    lab = encode_labels(doc_labels, lmap)
    comps = (lab.join(vec, "doc_id").select("label_id", F.posexplode("vec").alias("d", "x"))
             .groupBy("label_id", "d").agg(F.avg("x").alias("x")))
    return comps.groupBy("label_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("w")).withColumn(
        "bias", F.lit(0.0))


@dataclass
class Scorer:
    """Packed weights and label names of R4 / R3: either a broadcast (names,
    matrix, bias) in order of label id, or blocks of any size and the label map."""

    local: Broadcast | None
    blocks: PackedKeys | None
    lmap: DataFrame


def pack_scorer(spark: SparkSession, weights: DataFrame, lmap: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> Scorer:
    """Packs (label_id, w, bias) and (label, label_id) once for any number of batches."""
    rows = write_and_read(weights.join(lmap.select("label_id", "label"), "label_id").select("label_id", "label", F.col("w").cast("array<double>").alias("w"), "bias"), "scorer")
    size = rows.agg(F.sum(F.size("w") * 8 + F.octet_length("label")).alias("b")).first()["b"] or 0
    if size > broadcast_bytes:
        return Scorer(None, pack_weights(rows), lmap)
    found = rows.orderBy("label_id").collect()
    return Scorer(spark.sparkContext.broadcast((
        [r["label"] for r in found], np.array([r["w"] for r in found], np.float64), np.array([r["bias"] or 0.0 for r in found], np.float64))), None, lmap)


def score_batch(reports: DataFrame, scorer: Scorer, k: int = 3, dim: int = DIM) -> DataFrame:
    """(doc_id, labels): the k best label names per report, best first."""
    if scorer.local is None:
        scores = linear_scores(text_vectors(reports, dim=dim), scorer.blocks, k=k)
        # Rounded so that equal scores tie exactly whatever the float path.
        return predict_labels(scores.withColumn("score", F.round("score", SIM_DECIMALS)), scorer.lmap, k)
    local = scorer.local

    def each(batches):
        names, matrix, bias = local.value
        for b in batches:
            best = [[] for _ in range(b.num_rows)]
            if names and b.num_rows:
                rows, cols = best_columns(_bags(b.column(1), dim) @ matrix.T + bias, k)
                for r, c in zip(rows.tolist(), cols.tolist()):
                    best[r].append(names[c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(x) for x in best], pa.string())], ["doc_id", "labels"])

    src = _word_buckets(reports, "text", "doc_id", dim)
    return src.mapInArrow(each, T.StructType([src.schema["doc_id"], T.StructField("labels", T.StringType())]))


def score_stream(spark: SparkSession, source_dir: str, scorer: Scorer, sink_dir: str,
                 checkpoint_dir: str, k: int = 3, file_glob: str = "documents.parquet",
                 schema: str = "doc_id bigint, text string") -> None:
    """Run the stream until every available file is scored (availableNow). What
    ``file_glob`` finds in the folder is a file or a folder of files (a table
    written by several tasks)."""
    # A plain name is spelled as a pattern, as a stream refuses the path of one file.
    found = file_glob if any(c in file_glob for c in "*?[{") else f"[{file_glob[0]}]{file_glob[1:]}"
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", 16).parquet(f"{source_dir.rstrip('/')}/{found}"))

    def run(batch: DataFrame, epoch_id: int) -> None:
        out = score_batch(batch, scorer, k)
        out.write.mode("overwrite").parquet(os.path.join(sink_dir, f"epoch={epoch_id}"))

    q = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
