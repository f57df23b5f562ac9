"""Registered queries for label features (A19, SQL-checked) and label groups
(A20/A21, iterative: rows check plus invariant tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnxml.operators import vocab as W
from vulnxml.operators.cluster import group_export, label_features, split_label_groups
from vulnxml.plans.queries_vocab import MODEL, TT, doc_split, dsql
from vulnxml.sources.fixtures import fx_doclabels
from vulnxml.sources.tables import read_table

Q, S = {}, {}
MAX_LEAF = 4


def _label_feats(spark, sf):
    d = read_table(spark, sf, "documents")
    model = W.tfidf_fit(d.join(doc_split(spark, sf).filter("split = 'train'"), "doc_id"))
    return label_features(W.tfidf_transform(d, model), fx_doclabels(spark, sf))


Q["A19_label_features"] = lambda spark, sf: _label_feats(spark, sf).select(
    "label", F.col("term_id").cast("bigint").alias("term_id"), F.round("weight", 6).alias("weight"))
S["A19_label_features"] = dsql(
    "select label, term_id, round(s / sqrt(sum(s * s) over (partition by label)), 6) as weight from (select l.label, "
    "f.term_id, sum(f.weight) as s from feats f join (select distinct doc_id, label from fx_doclabels) l using "
    "(doc_id) group by l.label, f.term_id) x",
    [TT, MODEL, ("feats", "select doc_id, term_id, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from "
                          "(select t.doc_id, m.term_id, count(*) * max(m.idf) as w from tt t join model m using (term) "
                          "group by t.doc_id, m.term_id) x")])


def _q_groups(spark, sf):
    return split_label_groups(_label_feats(spark, sf), max_leaf=MAX_LEAF, seed=3, labels=fx_doclabels(spark, sf)).select(
        "label", F.col("group_id").cast("bigint").alias("group_id"), "node")


def _q_export(spark, sf):
    g = split_label_groups(_label_feats(spark, sf), max_leaf=MAX_LEAF, seed=3, labels=fx_doclabels(spark, sf))
    return group_export(g).select(F.col("group_id").cast("bigint").alias("group_id"),
                                  F.array_join("labels", "|").alias("labels"))


Q["A20_split_label_groups"] = _q_groups
Q["A21_group_export"] = _q_export

QUERIES_CLUSTER, ORACLE_CLUSTER = Q, S
