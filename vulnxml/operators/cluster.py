"""Label features and balanced label groups.

A20 splits every over-sized node of a level in the same Spark jobs
(level-synchronous balanced 2-means): similarities are sparse dot products
by a join on (node, term); the balanced cut is an exact quantile of d1 - d0 per
node, found by a sketch and a count (labels are not sorted or numbered); the
new centres are normalised sums per (node, side, term). A round is one job,
whose result is written and read back. Nodes that fit a bounded group are split
to their leaves inside one task each, so only the top levels take rounds.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.operators.ids import median_bracket, rank_cuts, with_sequential_id
from vulnxml.session import write_and_read

# Differences of similarities are compared after rounding to this many decimals.
SIM_DECIMALS = 9
# Feature rows of a node that one task may split.
NODE_ROWS = 1 << 21


def _l2(df: DataFrame, keys: list[str], w: str = "weight") -> DataFrame:
    """Unit length per key. The norms are a partial aggregate (one row per key)
    joined back, so no window gathers a key's rows."""
    norms = df.groupBy(*keys).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("_norm"))
    out = df.join(norms, keys)
    return out.withColumn(w, F.when(F.col("_norm") > 0, F.col(w) / F.col("_norm")).otherwise(F.col(w))).drop("_norm")


def label_features(features: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(label, term_id, weight) = L2 of the sum of the (unit) feature rows
    of the label's docs."""
    # Both are read twice by the scaling, for the norms and for the rows.
    rows = _l2(write_and_read(features.select("doc_id", "term_id", "weight"), "doc-feats"), ["doc_id"])
    summed = (rows.join(doc_labels.select("doc_id", "label").distinct(), "doc_id")
              .groupBy("label", "term_id").agg(F.sum("weight").alias("weight")))
    return _l2(write_and_read(summed, "label-sums"), ["label"])


def _rounded(col: F.Column) -> F.Column:
    """d1 - d0 as an integer: sums have no fixed order, so near-ties are equal."""
    return F.round(col * F.lit(10.0 ** SIM_DECIMALS)).cast("bigint")


def _round(work: DataFrame, feats: DataFrame, centers: DataFrame, prev: DataFrame, eps: float) -> DataFrame:
    """(label, lid, node, side, obj, stop): one round of balanced 2-means for
    all nodes of ``work`` (label, lid, node). ``centers``: (node, term_id, c0, c1)."""
    dots = (feats.join(work.select("label", "node"), "label").join(centers, ["node", "term_id"]).groupBy("node", "label")
            .agg(F.sum(F.col("weight") * F.col("c0")).alias("d0"), F.sum(F.col("weight") * F.col("c1")).alias("d1")))
    # One integer orders a node's labels: the rounded difference, then the label.
    key = F.shiftleft(_rounded(F.col("d1") - F.col("d0")) + F.lit(1 << 31), 31).bitwiseOR(F.col("lid"))
    sims = work.join(dots, ["node", "label"], "left").fillna(0.0, ["d0", "d1"]).withColumn("key", key)
    cuts = rank_cuts(sims, "node", median_bracket(sims, "node"))
    sides = sims.join(cuts, "node").select(
        "label", "lid", "node", (F.col("key") >= F.col("cut")).cast("int").alias("side"),
        F.when(F.col("key") < F.col("cut"), F.col("d0")).otherwise(F.col("d1")).alias("sim"))
    gain = sides.groupBy("node").agg(F.avg("sim").alias("obj")).join(prev, "node", "left")
    return sides.join(gain, "node").select("label", "lid", "node", "side", "obj", F.coalesce(F.col("obj") - F.col("prev") < eps, F.lit(False)).alias("stop"))


def _centers(rows: DataFrame) -> DataFrame:
    """(node, term_id, c0, c1): unit sums of the rows (node, side, term_id, weight)."""
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("weight")).otherwise(0.0))
    sums = rows.groupBy("node", "term_id").agg(of(0).alias("c0"), of(1).alias("c1"))
    norms = sums.groupBy("node").agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n{c}") for c in ("c0", "c1")])
    unit = [F.when(F.col(f"n{c}") > 0, F.col(c) / F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in ("c0", "c1")]
    return sums.join(norms, "node").select("node", "term_id", *unit)


def _split_rest(seed: int, max_leaf: int, eps: float, decimals: int) -> Callable[[pa.Table], pa.Table]:
    """The same splits, carried on to the leaves, for one node of bounded size."""
    def solve(part: pa.Table) -> pa.Table:
        part = part.sort_by("lid")
        label, top = part.column("label").to_pylist(), part.column("node")[0].as_py()
        terms, weights = part.column("terms").combine_chunks(), part.column("weights").combine_chunks()
        begin = np.concatenate(([0], np.cumsum(np.diff(terms.offsets.to_numpy()))))
        _, term = np.unique(terms.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        weight = weights.flatten().to_numpy(zero_copy_only=False)
        size = int(term.max()) + 1 if len(term) else 1
        out, todo = [""] * len(label), [(top, np.arange(len(label)))]
        while todo:
            node, at = todo.pop()
            if len(at) <= max_leaf:
                for i in at.tolist():
                    out[i] = node
                continue
            counts = begin[at + 1] - begin[at]
            own = np.repeat(np.arange(len(at)), counts)
            place = np.repeat(begin[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            t, w = term[place], weight[place]
            first = sorted(range(len(at)), key=lambda i: (hashlib.md5(f"{seed}|{node}|{label[at[i]]}".encode()).hexdigest(), label[at[i]]))[:2]
            c = [np.bincount(t[own == i], w[own == i], size) for i in first]
            before = None
            while True:
                d = [np.bincount(own, w * x[t], len(at)) for x in c]
                order = np.lexsort((np.arange(len(at)), np.round((d[1] - d[0]) * 10.0 ** decimals)))
                side = np.ones(len(at), bool)
                side[order[:len(at) // 2]] = False
                obj = float(np.where(side, d[1], d[0]).mean())
                if before is not None and obj - before < eps:
                    break
                before = obj
                c = [np.bincount(t, w * (side[own] == s), size) for s in (False, True)]
                c = [x / n if (n := float(np.sqrt((x * x).sum()))) > 0 else x for x in c]
            todo += [(node + "0", at[~side]), (node + "1", at[side])]
        return pa.table({"label": part.column("label"), "node": pa.array(out, pa.string())})

    return solve


def split_label_groups(label_feats: DataFrame, max_leaf: int = 100, eps: float = 1e-4, seed: int = 0,
                       labels: DataFrame | None = None, saved: dict[int, DataFrame | None] | None = None,
                       node_rows: int = NODE_ROWS) -> DataFrame:
    """(label, group_id, node) - top-down balanced 2-means until every
    node has at most ``max_leaf`` labels; finished leaves are kept. Each node
    goes on until its own mean similarity grows by less than ``eps``. ``labels``
    (label): labels that may have no feature row; they have similarity 0.
    Features are taken at unit length. A node of more than ``node_rows`` feature
    rows is split by all tasks together; below that a task splits it to its end.
    ``saved``: its keys are the levels wanted; the groups of level x, with 2**x
    nodes, become its value (None stays where no level has so many)."""
    feats = write_and_read(_l2(label_feats.select("label", "term_id", "weight"), ["label"]), "label-feats")
    names = feats.select("label") if labels is None else feats.select("label").union(labels.select("label"))
    sizes = feats.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    names = with_sequential_id(names.distinct().join(sizes, "label", "left").fillna(1, ["m"]), ["label"], "lid")
    assign = write_and_read(names.withColumn("node", F.lit("")), "label-nodes")
    if assign.where(F.col("lid") >= 1 << 31).limit(1).count():
        raise ValueError("more than 2^31 labels")

    def over(rows: int) -> DataFrame:
        per = assign.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.sum("m").alias("_m"))
        return per.where((F.col("_n") > max_leaf) & (F.col("_m") > rows)).select("node")

    while True:
        big = over(node_rows)
        if big.isEmpty():
            break
        work = write_and_read(assign.join(big, "node").select("label", "lid", "node"), "label-work")
        # Initial centres: the two labels of smallest md5(seed|node|label).
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), "node", "label"))
        first = F.row_number().over(Window.partitionBy("node").orderBy("_h", "label"))
        init = work.withColumn("_h", h).withColumn("_k", first).where("_k <= 2").select("node", "label", (F.col("_k") - 1).alias("side"))
        centers = init.join(feats, "label").groupBy("node", "term_id").agg(
            *[F.sum(F.when(F.col("side") == s, F.col("weight")).otherwise(0.0)).alias(f"c{s}") for s in (0, 1)])
        prev = work.select("node").distinct().withColumn("prev", F.lit(None).cast("double"))
        ended = []
        while True:
            sides = write_and_read(_round(work, feats, centers, prev, eps), "label-sides")
            ended.append(sides.where("stop").select("label", F.concat("node", F.col("side").cast("string")).alias("_new")))
            work = sides.where("not stop")
            if work.isEmpty():
                break
            prev = work.groupBy("node").agg(F.max("obj").alias("prev"))
            centers = _centers(feats.join(work.select("label", "node", "side"), "label"))
        moved = functools.reduce(DataFrame.unionByName, ended)
        assign = write_and_read(assign.join(moved, "label", "left").select("label", "lid", "m", F.coalesce("_new", "node").alias("node")), "label-nodes")

    rest = over(0)
    by_label = feats.groupBy("label").agg(F.collect_list("term_id").alias("terms"), F.collect_list("weight").alias("weights"))
    empty = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    todo = (assign.join(rest, "node").join(by_label, "label", "left")
            .select("node", "label", "lid", F.coalesce(F.col("terms").cast("array<bigint>"), empty[0]).alias("terms"), F.coalesce(F.col("weights").cast("array<double>"), empty[1]).alias("weights")))
    split = todo.groupBy("node").applyInArrow(_split_rest(seed, max_leaf, eps, SIM_DECIMALS), "label string, node string")
    leaves = write_and_read(assign.join(rest, "node", "left_anti").select("label", "node").unionByName(split), "label-leaves")

    def numbered(nodes: DataFrame) -> DataFrame:
        ids = with_sequential_id(nodes.select("node").distinct(), ["node"], "group_id")
        return nodes.join(ids, "node").select("label", "group_id", "node")

    if saved:
        # A label's node on a level is its path up to there.
        depth = leaves.agg(F.max(F.length("node"))).first()[0] or 0
        for level in range(depth + 1):
            nodes = leaves.select("label", F.substring("node", 1, level).alias("node"))
            n = nodes.select("node").distinct().count()
            saved.update({x: numbered(nodes) for x in saved if 2 ** x == n})
    return numbered(leaves)


def group_export(groups: DataFrame) -> DataFrame:
    """Group -> its label names (sorted)."""
    return groups.groupBy("group_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
