"""Scoring, ranking, ensembles and candidate sampling.

Scores are long tables ``(model, doc_id, label_id, score)``. Per-doc top-k is
``row_number() over (partition by doc order by score desc, label)`` filtered
by ``<= k``, which Catalyst plans with a WindowGroupLimit (partial top-k
before the shuffle). A doc's rows are at most one per label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.arrays import sigmoid
from vulnxml.session import write_and_read


def seeded_int(seed, *cols) -> Column:
    """Deterministic pseudo-random non-negative int from md5(seed|cols...)."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), F.col(c).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def top_k(scores: DataFrame, k: int, by=("doc_id",), label_col: str = "label_id",
          score_col: str = "score") -> DataFrame:
    """The k best labels per ``by`` group, best first, with ``rank`` 1..k
    (ties: label ascending)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score_col), F.asc(label_col))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def predict_labels(scores: DataFrame, lmap: DataFrame, k: int = 3, by=("doc_id",)) -> DataFrame:
    """Sigmoid, rank, the first k label names per doc (or other ``by``) ->
    (by..., labels = names joined by ',' best first)."""
    ranked = top_k(scores.withColumn("score", sigmoid("score")), k, by)
    named = ranked.join(lmap.select("label", "label_id"), "label_id")
    return named.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]),
                     ",").alias("labels"))


def ensemble_sum(scores: DataFrame, all_name: str = "all") -> DataFrame:
    """Each model's sigmoid scores plus model ``all`` = their sum per
    (doc, label). The sum is a groupBy with map-side partial aggregation."""
    single = scores.select("model", "doc_id", "label_id", sigmoid("score").alias("score"))
    total = single.groupBy("doc_id", "label_id").agg(F.sum("score").alias("score")).select(
        F.lit(all_name).alias("model"), "doc_id", "label_id", "score")
    return single.unionByName(total)


def ensemble_lists(predictions: DataFrame, k: int = 10) -> DataFrame:
    """Models give (doc, label, score) top lists; scores are summed per label
    (a label missing from a list adds 0) and re-ranked -> top k."""
    summed = predictions.groupBy("doc_id", "label_id").agg(F.sum("score").alias("score"))
    return top_k(summed, k)


def threshold_labels(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Labels whose (sigmoid) score is at least the threshold."""
    return scores.filter(F.col("score") >= threshold)


def expand_groups(group_scores: DataFrame, groups: DataFrame, topk: int, truth: DataFrame | None = None) -> DataFrame:
    """Sigmoid the group scores, keep the best ``topk`` groups per doc, and
    give every member label its group's score -> (doc_id, label, group_id, group_score).
    Training form: 1 is added to the score of each pair in ``truth`` (doc_id, group_id)."""
    scores = group_scores.withColumn("score", sigmoid("score"))
    if truth is not None:
        true = truth.select("doc_id", "group_id").distinct().withColumn("_true", F.lit(1.0))
        scores = scores.join(true, ["doc_id", "group_id"], "left").withColumn("score", F.col("score") + F.coalesce("_true", F.lit(0.0))).drop("_true")
    best = top_k(scores, topk, label_col="group_id")
    return (best.join(groups.select("label", "group_id"), "group_id")
            .select("doc_id", "label", "group_id", F.col("score").alias("group_score")))


def rescore_candidates(candidates: DataFrame, doc_vecs: DataFrame, label_vecs: DataFrame, k: int = 100) -> DataFrame:
    """score = sigmoid(doc_vec . label_vec) * group_score, best k per doc.
    Only the surviving candidates of R7 are joined to vectors."""
    from vulnxml.operators.vectors import dot
    scored = (candidates.join(label_vecs.select("label", F.col("vec").alias("lv")), "label")
              .join(doc_vecs.select("doc_id", F.col("vec").alias("dv")), "doc_id")
              .select("doc_id", "label", (sigmoid(dot("dv", "lv")) * F.col("group_score")).alias("score")))
    return top_k(scored, k, label_col="label")


def group_labels(doc_labels: DataFrame, groups: DataFrame) -> DataFrame:
    """True labels -> set of true groups (doc_id, group_id)."""
    return doc_labels.join(groups.select("label", "group_id"), "label").select("doc_id", "group_id").distinct()


def sample_candidates(doc_labels: DataFrame, groups: DataFrame, labels: DataFrame, n: int, seed: int = 0,
                      keep_positives: bool = True) -> DataFrame:
    """Per doc exactly min(n, #labels) candidate labels.

    Candidates are all labels of the doc's true groups. More than n: keep
    the true labels first (``keep_positives``), then the smallest seeded hash.
    Fewer than n: fill from labels not yet chosen, read off a seeded cyclic
    order of all labels starting at a per-doc offset (n consecutive positions
    always hold enough new labels), so no doc x label product is formed.
    -> (doc_id, label, is_true)."""
    # Labels, groups and chosen candidates are each read several times: written once.
    truth = write_and_read(doc_labels.select("doc_id", "label").distinct(), "truth")
    groups = write_and_read(groups.select("label", "group_id"), "groups")
    pool = (group_labels(truth, groups).join(groups.select("label", "group_id"), "group_id")
            .select("doc_id", "label").distinct()
            .join(truth.withColumn("is_true", F.lit(True)), ["doc_id", "label"], "left")
            .fillna(False, ["is_true"]))
    if not keep_positives:
        pool = pool.withColumn("is_true", F.lit(False))
    w = Window.partitionBy("doc_id").orderBy(F.desc("is_true"), seeded_int(seed, "doc_id", "label"), "label")
    chosen = write_and_read(pool.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("doc_id", "label", "is_true"), "chosen")
    have = chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_have"))
    # Permutation of all labels by a seeded hash (numbered without a single-task window).
    lab = labels.select("label").distinct()
    n_lab = lab.count()
    from vulnxml.operators.ids import with_sequential_id
    perm = with_sequential_id(lab.withColumn("_o", seeded_int(seed, "label")), ["_o", "label"], "_p").drop("_o")
    docs = truth.select("doc_id").distinct().join(have, "doc_id", "left").fillna(0, ["_have"])
    need = docs.filter(F.col("_have") < F.lit(min(n, n_lab)))
    slots = (need.select("doc_id", "_have", F.posexplode(F.sequence(F.lit(0), F.lit(min(n, n_lab) - 1))).alias("_j", "_x"))
             .withColumn("_p", F.pmod(seeded_int(seed, "doc_id") + F.col("_j"), F.lit(max(n_lab, 1))))
             .drop("_x"))
    fill = (slots.join(perm, "_p").join(chosen.select("doc_id", "label"), ["doc_id", "label"], "left_anti"))
    wf = Window.partitionBy("doc_id").orderBy("_j")
    fill = (fill.withColumn("_k", F.row_number().over(wf))
            .filter(F.col("_k") <= F.lit(min(n, n_lab)) - F.col("_have"))
            .select("doc_id", "label", F.lit(False).alias("is_true")))
    return chosen.select("doc_id", "label", "is_true").unionByName(fill)


def best_candidates_targets(candidates: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """0/1 target per candidate slot. True labels missing from a doc's
    list replace its non-true candidates, first slots first.
    candidates: (doc_id, slot, label) -> (doc_id, slot, label, target)."""
    candidates = write_and_read(candidates.select("doc_id", "slot", "label"), "candidates")
    truth = write_and_read(doc_labels.select("doc_id", "label").distinct(), "truth")
    flagged = (candidates.join(truth.withColumn("_t", F.lit(1)), ["doc_id", "label"], "left")
               .withColumn("target", F.coalesce("_t", F.lit(0))).drop("_t"))
    missing = truth.join(candidates.select("doc_id", "label"), ["doc_id", "label"], "left_anti")
    missing = missing.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("label")))
    free = flagged.filter("target = 0").withColumn(
        "_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("slot")))
    repl = free.select("doc_id", "slot", "_k").join(missing.select("doc_id", "_k", F.col("label").alias("_new")),
                                                    ["doc_id", "_k"])
    return (flagged.join(repl.select("doc_id", "slot", "_new"), ["doc_id", "slot"], "left")
            .select("doc_id", "slot", F.coalesce("_new", "label").alias("label"),
                    F.when(F.col("_new").isNotNull(), 1).otherwise(F.col("target")).alias("target")))
