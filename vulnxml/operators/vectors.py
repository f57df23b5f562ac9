"""Dense-vector operators: nearest key (R9), linear scores (R4), mean word
vectors (A18), vector lookup with zero fill (J10), hashed text vectors.

Vectors are ``array<double>`` columns. A label or key matrix meets the vectors
in one plan at every size: the matrix is packed into blocks of bounded bytes,
the vectors into chunks of bounded bytes, and an equi join on the block number
brings each chunk past each block. Both travel compressed, as bag-of-words
vectors are mostly zeros, and always by a shuffle: a file of such blocks is many
times smaller than its rows, so the optimiser would send a matrix of any size
through the driver. A task holds one chunk, one block and a bounded slice of their
product at a time, and keeps the best ``k`` of a block, not the whole product.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.text import words
from vulnxml.session import write_and_read

# Similarities are compared after rounding to this many decimals (ties -> key).
SIM_DECIMALS = 9
# Bytes of a block of keys, of a chunk of vectors and of a slice of their product.
BLOCK_BYTES = 4 << 20
# Tasks that share the chunks of one block at most.
SALTS = 16
# Bytes of word vectors that every task holds for A18.
SHARED_BYTES = 32 << 20


def unit(col) -> F.Column:
    """Unit-length vector (zero vector unchanged)."""
    c = F.col(col) if isinstance(col, str) else col
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(c, lambda x: x / norm)).otherwise(c)


def dot(a, b) -> F.Column:
    """Dot product of two equal-length array<double> columns (SQL form)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


@dataclass
class PackedKeys:
    """A key or label matrix, packed once: blocks (blk, names, mat, bias) as a
    written table, and the vectors' length."""

    blocks: DataFrame
    n_blocks: int
    dim: int
    name_type: str


def pack_keys(keys: DataFrame, name_type: str, cosine: bool) -> PackedKeys:
    """Packs the rows of ``keys`` (name, vec, bias) into blocks of about
    ``BLOCK_BYTES``, sorted by name inside a block. ``cosine``: at unit length."""
    keys = write_and_read(keys, "keys")
    size = keys.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = max(1, size["dim"] or 1)
    n_blocks = max(1, -(-size["n"] // max(1, BLOCK_BYTES // (8 * dim))))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("name")
        mat = _matrix(part.column("vec"), dim)
        mat = _unit_rows(mat) if cosine else mat
        return pa.table({"blk": part.column("blk")[:1], "names": pa.array([part.column("name").to_pylist()], pa.list_(out_type)),
                         "mat": pa.array([_pressed(mat)], pa.binary()), "bias": pa.array([part.column("bias").to_pylist()], pa.list_(pa.float64()))})

    out_type = pa.int64() if name_type == "long" else pa.string()
    packed = (keys.withColumn("blk", F.pmod(F.xxhash64("name"), F.lit(n_blocks)))
              .groupBy("blk").applyInArrow(pack, f"blk long, names array<{name_type}>, mat binary, bias array<double>"))
    return PackedKeys(write_and_read(packed, "key-blocks"), n_blocks, dim, name_type)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _pressed(mat: np.ndarray) -> bytes:
    return zlib.compress(mat.tobytes(), 1)


def _unpressed(data: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data.as_buffer()), dtype=np.float64).reshape(rows, -1)


def _chunks(vectors: DataFrame, dim: int) -> DataFrame:
    """(ids, x): the rows of ``vectors`` (id, vec) in chunks of at most
    ``BLOCK_BYTES``, made inside each partition."""
    per_chunk = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, per_chunk):
                part = b.slice(at, per_chunk)
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_pressed(_matrix(part.column("vec"), dim))], pa.binary())],
                    ["ids", "x"])
    return vectors.select(F.col("id").cast("string").alias("id"), "vec").mapInArrow(pack, "ids array<string>, x binary")


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` best scores of each row, best first. Scores
    are ranked after rounding, so that mathematically equal ones tie exactly and
    fall to the column order, whatever the float path. Only the columns that
    reach the k-th score are put in order."""
    k = min(k, s.shape[1])
    least = s.max(axis=1) if k == 1 else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    rows, cols = np.nonzero(s >= (np.round(least, SIM_DECIMALS) - 10.0 ** -SIM_DECIMALS)[:, None])
    order = np.lexsort((cols, -np.round(s[rows, cols], SIM_DECIMALS), rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _scores(vectors: DataFrame, keys: PackedKeys, k: int | None, cosine: bool) -> DataFrame:
    """(id string, name, score): every key's score, or the best ``k`` per vector
    (ranked by rounded score, ties to the smaller name)."""
    # Few blocks are copied, so that every core gets one; many are not.
    salts = max(1, min(SALTS, 2 * vectors.sparkSession.sparkContext.defaultParallelism // keys.n_blocks))
    salted = keys.blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = (_chunks(vectors, keys.dim).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
             .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys.n_blocks - 1).cast("long"))))
             .join(salted.hint("merge"), ["blk", "salt"]).select("ids", "x", "names", "mat", "bias"))

    def score(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, names = b.column("ids")[r].values, b.column("names")[r].values
                x, mat = _unpressed(b.column("x")[r], len(ids)), _unpressed(b.column("mat")[r], len(names))
                bias = b.column("bias")[r].values.to_numpy()
                x = _unit_rows(x) if cosine else x
                step = max(1, BLOCK_BYTES // (8 * len(names)))
                for at in range(0, len(ids), step):
                    s = x[at:at + step] @ mat.T + bias
                    if k is None:
                        rows, cols = np.repeat(np.arange(len(s)), len(names)), np.tile(np.arange(len(names)), len(s))
                    else:
                        rows, cols = best_columns(s, k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + at)), names.take(pa.array(cols)), pa.array(s[rows, cols], pa.float64())],
                                                     ["id", "name", "score"])

    out = pairs.mapInArrow(score, f"id string, name {keys.name_type}, score double")
    if k is None or keys.n_blocks == 1:
        return out
    w = Window.partitionBy("id").orderBy(F.desc(F.round("score", SIM_DECIMALS)), "name")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def nearest_key(queries: DataFrame, keys: DataFrame, query_col: str = "query", key_col: str = "key",
                vec_col: str = "vec") -> DataFrame:
    """For each query vector the training key of highest cosine similarity
    (ties to the smaller key) -> (query, nearest, sim); nulls without keys."""
    q = queries.select(F.col(query_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kk = keys.select(F.col(key_col).cast("string").alias("name"), F.col(vec_col).cast("array<double>").alias("vec"),
                     F.lit(0.0).alias("bias"))
    if keys.isEmpty():
        return q.select(F.col("id").alias("query"), F.lit(None).cast("string").alias("nearest"),
                        F.lit(None).cast("double").alias("sim"))
    return _scores(q, pack_keys(kk, "string", cosine=True), 1, cosine=True).select(
        F.col("id").alias("query"), F.col("name").alias("nearest"), F.col("score").alias("sim"))


def pack_weights(weights: DataFrame, label_col: str = "label_id", bias_col: str | None = "bias") -> PackedKeys:
    """The weights of R4 (label, w, bias), packed once for any number of calls."""
    b = F.coalesce(F.col(bias_col).cast("double"), F.lit(0.0)) if bias_col else F.lit(0.0)
    return pack_keys(weights.select(F.col(label_col).cast("long").alias("name"), F.col("w").cast("array<double>").alias("vec"), b.alias("bias")), "long", cosine=False)


def linear_scores(vectors: DataFrame, weights: DataFrame | PackedKeys, id_col: str = "doc_id", label_col: str = "label_id",
                  bias_col: str | None = "bias", k: int | None = None) -> DataFrame:
    """logit = w_label . x + b_label -> (doc_id, label_id, score), for every
    label or, with ``k``, for the k best labels of each vector."""
    packed = weights if isinstance(weights, PackedKeys) else pack_weights(weights, label_col, bias_col)
    v = vectors.select(F.col(id_col).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return _scores(v, packed, k, cosine=False).select(
        F.col("id").cast("long").alias(id_col), F.col("name").alias(label_col), "score")


def attach_vectors(vocab: DataFrame, vectors: DataFrame, dim: int, word_col: str = "word") -> DataFrame:
    """Vocabulary left-joined with word vectors; missing -> zero vector."""
    return (vocab.join(vectors.select(word_col, "vec"), word_col, "left")
            .withColumn("vec", F.coalesce(F.col("vec").cast("array<double>"),
                                          F.array_repeat(F.lit(0.0), dim))))


def mean_vectors(tokens: DataFrame, vectors: DataFrame, dim: int, id_col: str = "doc_id",
                 word_col: str = "word") -> DataFrame:
    """Doc vector = sum of its words' vectors / number of tokens (unknown
    words add zero but count); an empty doc gets the zero vector.

    tokens: (doc_id, pos, word); vectors: (word, vec). A word is counted once per
    doc and its vector weighted by the count, so a frequent word has at most one
    row per doc in the join. A doc's words bring back the numbers of their
    vectors; the vectors of the most frequent words, ``SHARED_BYTES`` at most,
    meet them where the doc lies, and only the rarer ones travel. There one
    aggregate sums every dimension, so that no partial sums are shuffled."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vecs = write_and_read(vectors.select(word_col, F.slice(F.col("vec").cast("array<double>"), 1, max(1, dim)).alias("_vec"),
                                         F.monotonically_increasing_id().alias("_row")), "vectors")
    most = max(1, SHARED_BYTES // (8 * max(1, dim)))
    if vecs.count() > most:
        counts = tokens.groupBy(word_col).agg(F.count(F.lit(1)).alias("_freq")).join(vecs, word_col)
        first = write_and_read(counts.select("_row", "_freq").orderBy(F.desc("_freq"), "_row").limit(most).select("_row", F.lit(True).alias("_near")), "near")
        vecs = write_and_read(vecs.join(F.broadcast(first), "_row", "left").fillna(False, ["_near"]), "vectors-near")
    else:
        vecs = vecs.withColumn("_near", F.lit(True))
    numbers = vecs.select(word_col, "_row", F.when(~F.col("_near"), F.col("_vec")).alias("_far"))
    shared = vecs.filter("_near").select("_row", F.col("_vec").alias("_shared"))
    tf = tokens.groupBy(id_col, word_col).agg(F.count(F.lit(1)).alias("_tf"))
    rows = (tf.join(numbers, word_col, "left").select(id_col, "_tf", "_row", "_far").repartition(parts, id_col)
            .join(F.broadcast(shared), "_row", "left").select(id_col, "_tf", F.coalesce("_shared", "_far").alias("_vec")))
    sums = [F.sum(F.get("_vec", F.lit(i)) * F.col("_tf")).alias(f"_s{i}") for i in range(dim)]
    per_doc = rows.groupBy(id_col).agg(F.sum("_tf").alias("_n"), *sums)
    return per_doc.select(id_col, F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / F.col("_n") for i in range(dim)]).alias("vec"))


def token_bucket(tok, dim: int):
    """Bucket of a token: md5 prefix as an integer, modulo dim (the same value
    in any engine that has md5)."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hashed_text_vectors(df: DataFrame, text_col: str, dim: int = 64, id_col: str = "key") -> DataFrame:
    """Bag-of-words vector of a short text (a library key): each whitespace
    token adds 1 at its md5 bucket. Stands in for a sentence encoder."""
    toks = words(text_col)
    buckets = F.transform(toks, lambda t: token_bucket(t, dim))
    # Folded, so that each token is hashed once.
    vec = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dim),
                      lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    return df.select(F.col(id_col), vec.alias("vec"))
