"""Evaluation metrics (M1-M7) as distributed aggregations.

Inputs are long tables: ranked predictions (doc_id, label, rank) and truth
(doc_id, label). Hits come from one equi join; per-doc sums are a groupBy on
doc_id (map-side partial aggregation) and the final means are a global
aggregate of a few numbers per doc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 6


def _hits(pred: DataFrame, truth: DataFrame, label_col: str) -> DataFrame:
    t = truth.select("doc_id", label_col).distinct().withColumn("_true", F.lit(1))
    return pred.join(t, ["doc_id", label_col], "left").withColumn("_hit", F.coalesce("_true", F.lit(0)))


def _evaluated(pred: DataFrame, truth: DataFrame, docs: DataFrame | None) -> DataFrame:
    """The documents to average over: those given, else all that have a
    prediction or a true label."""
    return docs.select("doc_id").distinct() if docs is not None else pred.select("doc_id").union(truth.select("doc_id")).distinct()


def _over_groups(df: DataFrame, pred: DataFrame, group_cols: list[str]) -> DataFrame:
    """``df`` once for each group of ``pred``. Groups (such as models) are few:
    their list is collected and each row exploded over it."""
    if not group_cols:
        return df
    found = pred.select(*group_cols).distinct().collect()
    if not found:
        return df.limit(0).select("*", *[F.lit(None).cast(pred.schema[c].dataType).alias(c) for c in group_cols])
    groups = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(group_cols, g)]) for g in found])
    return df.withColumn("_g", F.explode(groups)).select(*df.columns, "_g.*")


def per_doc_hits(pred: DataFrame, truth: DataFrame, ks=(1, 2, 3), label_col: str = "label_id",
                 group_cols: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(group..., doc_id, n_true, h_1, h_2, ...) for every evaluated doc of every
    group, with predictions or without."""
    group_cols = group_cols or []
    hits = _hits(pred, truth, label_col)
    aggs = [F.sum(F.when(F.col("rank") <= k, F.col("_hit")).otherwise(0)).alias(f"h_{k}") for k in ks]
    found = hits.groupBy(*group_cols, "doc_id").agg(*aggs)
    n_true = truth.select("doc_id", label_col).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = _over_groups(_evaluated(pred, truth, docs).join(n_true, "doc_id", "left"), pred, group_cols)
    zero = {c: 0 for c in ["n_true", *(f"h_{k}" for k in ks)]}
    return base.join(found, [*group_cols, "doc_id"], "left").fillna(zero)


def _for_each_k(per_doc: DataFrame, ks, group_cols: list[str], cells) -> DataFrame:
    """One aggregate with the cells of all k, then a row for each k."""
    aggs = [c.alias(f"{name}_{k}") for k in ks for name, c in cells(k).items()]
    names = list(cells(ks[0]))
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{n}_{k}").alias(n) for n in names]) for k in ks])
    return per_doc.groupBy(*group_cols).agg(*aggs).select(*group_cols, F.explode(rows).alias("_r")).select(*group_cols, "_r.*")


def _f1() -> Column:
    return F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)


def prf_at_k(pred: DataFrame, truth: DataFrame, ks=(1, 2, 3), label_col: str = "label_id",
             group_cols: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """M1: P@k = mean h/k, R@k = mean h/|T| (docs without labels excluded from R and
    counted as n_unlabeled), F@k = 2PR/(P+R) of the means (0 when P+R = 0)."""
    group_cols = group_cols or []
    per_doc = per_doc_hits(pred, truth, ks, label_col, group_cols, docs)
    out = _for_each_k(per_doc, ks, group_cols, lambda k: {
        "p": F.avg(F.col(f"h_{k}") / F.lit(float(k))),
        "r": F.avg(F.when(F.col("n_true") > 0, F.col(f"h_{k}") / F.col("n_true"))),
        "n_docs": F.count(F.lit(1)), "n_unlabeled": F.sum(F.when(F.col("n_true") == 0, 1).otherwise(0))})
    return out.select(*group_cols, "k", F.round("p", ROUND).alias("precision"), F.round("r", ROUND).alias("recall"),
                      F.round(_f1(), ROUND).alias("f1"), F.col("n_docs").cast("bigint").alias("n_docs"),
                      F.col("n_unlabeled").cast("bigint").alias("n_unlabeled"))


def prf_pooled(pred: DataFrame, truth: DataFrame, ks=(1, 2, 3), label_col: str = "label_id",
               group_cols: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """M2: pooled precision sum(h)/(N*k), recall as M1, F = 0 when P + R = 0."""
    group_cols = group_cols or []
    per_doc = per_doc_hits(pred, truth, ks, label_col, group_cols, docs)
    out = _for_each_k(per_doc, ks, group_cols, lambda k: {
        "p": F.sum(f"h_{k}") / (F.count(F.lit(1)) * F.lit(float(k))),
        "r": F.avg(F.when(F.col("n_true") > 0, F.col(f"h_{k}") / F.col("n_true")))})
    return out.select(*group_cols, "k", F.round("p", ROUND).alias("precision"), F.round("r", ROUND).alias("recall"),
                      F.round(_f1(), ROUND).alias("f1"))


def precision_at(pred: DataFrame, truth: DataFrame, ks=(1, 3, 5), label_col: str = "label_id",
                 group_cols: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """M3: sum(h) / N / k per k (also usable for groups via label_col)."""
    group_cols = group_cols or []
    per_doc = per_doc_hits(pred, truth, ks, label_col, group_cols, docs)
    out = _for_each_k(per_doc, ks, group_cols, lambda k: {"p": F.sum(f"h_{k}") / F.count(F.lit(1)) / F.lit(float(k))})
    return out.select(*group_cols, "k", F.round("p", ROUND).alias("precision"))


def precision_k_positive(ranked: DataFrame, truth: DataFrame, k: int, label_col: str = "label_id",
                         group_cols: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """M4: top-k by score; a true label adds ceil(score), so only positive
    scores count. Returns one row (k, precision) per group."""
    group_cols = group_cols or []
    top = ranked.filter(F.col("rank") <= k)
    hits = _hits(top, truth, label_col)
    found = hits.groupBy(*group_cols, "doc_id").agg(F.sum(F.ceil("score") * F.col("_hit")).alias("num"))
    base = _over_groups(_evaluated(ranked, truth, docs), ranked, group_cols)
    per_doc = base.join(found, [*group_cols, "doc_id"], "left").fillna(0, ["num"])
    return per_doc.groupBy(*group_cols).agg(F.avg(F.col("num") / F.lit(float(k))).alias("p")).select(
        *group_cols, F.lit(k).alias("k"), F.round("p", ROUND).alias("precision"))


def f1_scores(pred: DataFrame, truth: DataFrame, labels: DataFrame, label_col: str = "label_id",
              group_cols: list[str] | None = None) -> DataFrame:
    """M5: micro F1 = 2TP/(2TP+FP+FN); macro F1 = mean per-label F1 over all
    labels of ``labels`` (0 when a label's F1 is undefined).

    pred/truth: (doc_id, label) sets. A full outer join gives TP/FP/FN per label."""
    by = group_cols or []
    p = pred.select(*by, "doc_id", label_col).distinct().withColumn("_p", F.lit(1))
    t = _over_groups(truth.select("doc_id", label_col).distinct(), pred, by).withColumn("_t", F.lit(1))
    both = p.join(t, [*by, "doc_id", label_col], "full_outer")
    per_label = both.groupBy(*by, label_col).agg(
        F.sum(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_p").isNotNull() & F.col("_t").isNull(), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_p").isNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("fn"))
    all_labels = (_over_groups(labels.select(label_col).distinct(), pred, by)
                  .join(per_label, [*by, label_col], "left").fillna(0, ["tp", "fp", "fn"]))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0)
    return all_labels.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(f1).alias("macro")).select(
        *by,
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        F.col("fn").cast("bigint").alias("fn"),
        F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                       2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), ROUND)
        .alias("micro_f1"),
        F.round("macro", ROUND).alias("macro_f1"))


def set_precision_recall(pred: DataFrame, truth: DataFrame, id_col: str = "report_id",
                         label_col: str = "label") -> DataFrame:
    """M6: P = hits / #predictions, R = hits / #true labels, over the docs of
    ``truth`` (null when a denominator is 0). One output row."""
    p = pred.select(id_col, label_col).distinct().withColumn("_p", F.lit(1))
    t = truth.select(id_col, label_col).distinct().withColumn("_t", F.lit(1))
    # One full outer join, one global aggregate: all three counts in one pass.
    row = p.join(t, [id_col, label_col], "full_outer").agg(
        F.count(F.when(F.col("_p").isNotNull() & F.col("_t").isNotNull(), 1)).alias("n_correct"),
        F.count("_p").alias("n_pred"), F.count("_t").alias("n_true"))
    return row.select(
        F.col("n_correct").cast("bigint").alias("n_correct"), F.col("n_pred").cast("bigint").alias("n_pred"),
        F.col("n_true").cast("bigint").alias("n_true"),
        F.round(F.try_divide(F.col("n_correct").cast("double"), F.col("n_pred")), ROUND).alias("precision"),
        F.round(F.try_divide(F.col("n_correct").cast("double"), F.col("n_true")), ROUND).alias("recall"))
