"""Approximate nearest neighbours by collision-counting hashing.

Vectors are scaled to unit length. Each of ``M`` random directions gives one
number per vector, kept as a sorted array. A query opens a window around its
own number in every array; a vector inside it collides. Windows grow by a
factor each round (virtual rehashing: no array is built again) and only the new
rims are counted. A vector that collides in ``SHARE`` of the arrays is verified
by its exact cosine. A query is done once a vector as near as its k-th found
would have reached that count with probability over 0.97; if windows cover
all, everything has been verified. There is no cap on candidates.

Vectors are dealt to blocks by a hash of the id, queries to blocks of their
own; each pair of blocks is one group of bounded size, and each query's best of
all blocks are merged. The query set is given (here: ids divisible by 50).

Null or zero vectors, those with a null or non-finite component, and rows with
a null id take no part. Vectors meet those of their own length only. Ties go to
the smaller id; rows that repeat an id count as different rows, each query row
with neighbours of its own, except that a query's own id is never its
neighbour. Fewer than k candidates: all of them. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M, SHARE, GROW, Z = 64, 0.6, 1.25, 2.0
#: Half-width of the first windows, for vectors of unit length.
FIRST = 0.6
BLOCK, QUERY_BLOCK = 8192, 2048
_ERF_X = np.linspace(0, 5, 2001)
_ERF_Y = np.concatenate(([0], np.cumsum(np.exp(-((_ERF_X[1:] + _ERF_X[:-1]) / 2) ** 2 / 2)) * (_ERF_X[1] - _ERF_X[0]) * np.sqrt(2 / np.pi)))


def collides(width: float, distance: float) -> float:
    """Chance that a vector at this distance is inside a window of this half-width."""
    return float(np.interp(width / max(distance, 1e-9), _ERF_X, _ERF_Y))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row sums in a fixed order: equal vectors get equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class Block:
    """The sorted arrays of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = M, seed: int = 9) -> None:
        self.ids, self.x, self.m = ids, x, m
        self.axes = np.random.default_rng(seed).standard_normal((x.shape[1], m))
        p = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ self.axes
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(p, axis=0).T)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest found other than ``own``."""
        n, need = len(self.ids), int(np.ceil(SHARE * self.m))
        at = (q / np.sqrt((q * q).sum())) @ self.axes
        counts, checked = np.zeros(n, np.int64), self.ids == own
        lo = np.array([np.searchsorted(a, v) for a, v in zip(self.sorted, at)])
        hi, width = lo.copy(), FIRST
        found_i, found_s = np.zeros(0, np.int64), np.zeros(0)
        while True:
            new = []
            for j in range(self.m):
                a, b = np.searchsorted(self.sorted[j], (at[j] - width, at[j] + width))
                a, b = min(a, lo[j]), max(b, hi[j])
                new += [self.order[j, a:lo[j]], self.order[j, hi[j]:b]]
                lo[j], hi[j] = a, b
            counts += np.bincount(np.concatenate(new), minlength=n)
            hit = np.flatnonzero((counts >= need) & ~checked)
            checked[hit] = True
            if len(hit):
                i, s = np.concatenate((found_i, hit)), np.concatenate((found_s, cosines(q, self.x[hit])))
                best = np.lexsort((self.ids[i], -s))[:k]
                found_i, found_s = i[best], s[best]
            if checked.all() or (lo == 0).all() and (hi == n).all():
                break
            if len(found_i) == k:
                chance = collides(width, float(np.sqrt(max(0.0, 2 - 2 * found_s[-1]))))
                if self.m * chance - Z * np.sqrt(self.m * chance * (1 - chance)) >= need:
                    break
            width *= GROW
        return self.ids[found_i], found_s


def usable(vec: Column) -> Column:
    """Every component finite, and not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    pick = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    # Equal query rows are searched once and counted.
    data, asked = pick(vectors), pick(queries).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))
    # One row per length of vectors.
    lengths = data.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).join(
        asked.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("m")), "dim").collect()
    blocks = lambda name, size: F.create_map(*[F.lit(x) for r in lengths for x in (r["dim"], max(1, -(-r[name] // size)))])
    if not lengths:
        return data.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    n_data, n_asked = blocks("n", block), blocks("m", query_block)

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            here = Block(left["id"].to_numpy(np.int64), np.array(left["v"].tolist(), np.float64))
            for own, q, times, mark in zip(right["id"].tolist(), right["v"], right["times"].tolist(), right["mark"]):
                ids, scores = here.search(own, np.asarray(q, np.float64), k)
                out.append(pd.DataFrame({"query_id": own, "mark": mark, "times": times, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query_id", "int64"), ("mark", "object"), ("times", "int64"), ("vec_id", "int64"), ("score", "float64"))})

    spread = lambda d, own, other, own_n, other_n, seed: d.withColumn("dim", F.size("v")).where(F.col("dim").isin([r["dim"] for r in lengths])).withColumn(
        own, F.pmod(F.xxhash64(F.lit(seed), "id"), own_n[F.col("dim")]).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), other_n[F.col("dim")] - 1)))
    left = spread(data, "d", "q", n_data, n_asked, 1).groupBy("dim", "d", "q")
    right = spread(asked.withColumn("mark", F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)), "q", "d", n_asked, n_data, 2).groupBy("dim", "d", "q")
    found = left.cogroup(right).applyInPandas(search, "query_id bigint, mark string, times bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")
