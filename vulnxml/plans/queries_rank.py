"""Registered queries for scoring, ranking, ensembles, metrics (R, M) and
dense-vector operators (R4, R7-R9), with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vulnxml.functions.arrays import sigmoid
from vulnxml.operators import metrics as M
from vulnxml.operators import rank as R
from vulnxml.operators import vectors as V
from vulnxml.session import write_and_read
from vulnxml.sources.fixtures import fx_groups, fx_labelmap, fx_labels, fx_scores, fx_truth, fx_vectors, with_fx

Q, S = {}, {}
SIG = "1.0 / (1.0 + exp(-score))"


BY_MODEL = ("model", "doc_id")


def fxs(body, extra=None):
    return with_fx(["fx_scores", "fx_truth", "fx_labelmap"], body, extra)


# ------------------------------------------------------------------ ranking
Q["R1_top_k"] = lambda spark, sf: R.top_k(fx_scores(spark, sf), 3, by=("model", "doc_id")).select(
    "model", "doc_id", "label_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))
S["R1_top_k"] = fxs("select model, doc_id, label_id, rank, round(score, 6) as score from (select *, "
                    "row_number() over (partition by model, doc_id order by score desc, label_id) as rank "
                    "from fx_scores) x where rank <= 3")

Q["R2_sigmoid"] = lambda spark, sf: fx_scores(spark, sf).select(
    "model", "doc_id", "label_id", F.round(sigmoid("score"), 6).alias("prob"))
S["R2_sigmoid"] = fxs(f"select model, doc_id, label_id, round({SIG}, 6) as prob from fx_scores")

Q["R3_predict_labels"] = lambda spark, sf: R.predict_labels(
    fx_scores(spark, sf), fx_labelmap(spark, sf), 3, BY_MODEL)
S["R3_predict_labels"] = fxs(
    "select model, doc_id, string_agg(label, ',' order by rank) as labels from (select s.model, s.doc_id, m.label, "
    f"row_number() over (partition by s.model, s.doc_id order by {SIG} desc, s.label_id) as rank from fx_scores s "
    "join fx_labelmap m using (label_id)) x where rank <= 3 group by model, doc_id")

Q["R5_ensemble_sum"] = lambda spark, sf: R.ensemble_sum(fx_scores(spark, sf)).select(
    "model", "doc_id", "label_id", F.round("score", 6).alias("score"))
S["R5_ensemble_sum"] = fxs(
    f"select model, doc_id, label_id, round({SIG}, 6) as score from fx_scores union all "
    f"select 'all', doc_id, label_id, round(sum({SIG}), 6) from fx_scores group by doc_id, label_id")


def _q_ensemble_lists(spark, sf):
    s = fx_scores(spark, sf).withColumn("score", sigmoid("score"))
    tops = R.top_k(s, 10, by=("model", "doc_id")).select("model", "doc_id", "label_id", "score")
    return R.ensemble_lists(tops, 10).select("doc_id", "label_id", F.col("rank").cast("bigint").alias("rank"),
                                            F.round("score", 6).alias("score"))


Q["R6_ensemble_lists"] = _q_ensemble_lists
S["R6_ensemble_lists"] = fxs(
    "select doc_id, label_id, rank, round(score, 6) as score from (select doc_id, label_id, score, row_number() over "
    "(partition by doc_id order by score desc, label_id) as rank from (select doc_id, label_id, sum(p) as score from "
    f"(select *, row_number() over (partition by model, doc_id order by p desc, label_id) as r from (select *, {SIG} "
    "as p from fx_scores) a) b where r <= 10 group by doc_id, label_id) c) d where rank <= 10")

Q["R10_threshold_labels"] = lambda spark, sf: R.threshold_labels(
    fx_scores(spark, sf).withColumn("score", sigmoid("score")), 0.5).select("model", "doc_id", "label_id")
S["R10_threshold_labels"] = fxs(f"select model, doc_id, label_id from fx_scores where {SIG} >= 0.5")


def _q_hits(spark, sf):
    from vulnxml.operators.labels import prediction_hits
    top = _top(spark, sf, 3).withColumn("rank", F.col("rank").cast("bigint"))
    return prediction_hits(top, fx_truth(spark, sf)).select("model", "doc_id", "label_id", "rank",
                                                            F.col("hit").cast("int").alias("hit"))


Q["J8_prediction_hits"] = _q_hits
TOP = ("top5", "select model, doc_id, label_id, rank from (select model, doc_id, label_id, row_number() over (partition "
               "by model, doc_id order by score desc, label_id) as rank from fx_scores) x where rank <= 5")
S["J8_prediction_hits"] = fxs(
    "select p.model, p.doc_id, p.label_id, p.rank, cast(case when t.doc_id is null then 0 else 1 end as int) as hit "
    "from top5 p left join fx_truth t on t.doc_id = p.doc_id and t.label_id = p.label_id where p.rank <= 3",
    [TOP])

# ------------------------------------------------------------------ metrics
HITS = ("hits", "select p.model, p.doc_id, p.rank, case when t.doc_id is null then 0 else 1 end as hit from top5 p "
                "left join fx_truth t on t.doc_id = p.doc_id and t.label_id = p.label_id")
NTRUE = ("ntrue", "select doc_id, count(*) as n_true from fx_truth group by doc_id")
PERDOC = ("perdoc", "select h.model, h.doc_id, sum(case when rank <= 1 then hit else 0 end) as h_1, "
                    "sum(case when rank <= 2 then hit else 0 end) as h_2, sum(case when rank <= 3 then hit else 0 end) "
                    "as h_3, sum(case when rank <= 5 then hit else 0 end) as h_5, coalesce(max(n.n_true), 0) as n_true "
                    "from hits h left join ntrue n using (doc_id) group by h.model, h.doc_id")


def _prf_sql(ks, extra_cols=True):
    parts = []
    for k in ks:
        parts.append(
            f"select model, {k} as k, avg(h_{k} / {float(k)}) as p, avg(case when n_true > 0 then h_{k} / n_true end) "
            "as r, count(*) as n_docs, sum(case when n_true = 0 then 1 else 0 end) as n_unlabeled from perdoc group by model")
    cols = ", cast(n_docs as bigint) as n_docs, cast(n_unlabeled as bigint) as n_unlabeled" if extra_cols else ""
    return ("select model, k, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / "
            f"(p + r) else 0.0 end, 6) as f1{cols} from (" + " union all ".join(parts) + ") x")


def _top(spark, sf, k=5):
    return R.top_k(fx_scores(spark, sf), k, by=BY_MODEL).select("model", "doc_id", "label_id", "rank", "score")


Q["M1_prf_at_k"] = lambda spark, sf: M.prf_at_k(
    _top(spark, sf), fx_truth(spark, sf), (1, 2, 3), group_cols=["model"]).withColumn(
    "k", F.col("k").cast("int"))
S["M1_prf_at_k"] = fxs(_prf_sql((1, 2, 3)), [TOP, HITS, NTRUE, PERDOC])

Q["M2_prf_pooled"] = lambda spark, sf: M.prf_pooled(
    _top(spark, sf), fx_truth(spark, sf), (1, 2, 3), group_cols=["model"]).withColumn(
    "k", F.col("k").cast("int"))
S["M2_prf_pooled"] = fxs(
    "select model, k, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) "
    "else 0.0 end, 6) as f1 from (" + " union all ".join(
        f"select model, {k} as k, sum(h_{k}) / (count(*) * {float(k)}) as p, avg(case when n_true > 0 then h_{k} / n_true end)"
        " as r from perdoc group by model" for k in (1, 2, 3)) + ") x", [TOP, HITS, NTRUE, PERDOC])

Q["M3_precision_at"] = lambda spark, sf: M.precision_at(
    _top(spark, sf), fx_truth(spark, sf), (1, 3, 5), group_cols=["model"]).withColumn(
    "k", F.col("k").cast("int"))
S["M3_precision_at"] = fxs(" union all ".join(
    f"select model, {k} as k, round(sum(h_{k}) / count(*) / {float(k)}, 6) as precision from perdoc group by model" for k in (1, 3, 5)),
    [TOP, HITS, NTRUE, PERDOC])


def _q_m4(spark, sf):
    s = fx_scores(spark, sf).withColumn("score", sigmoid("score"))
    return M.precision_k_positive(R.top_k(s, 3, by=BY_MODEL), fx_truth(spark, sf), 3, group_cols=["model"]).withColumn(
        "k", F.col("k").cast("int"))


Q["M4_precision_k_positive"] = _q_m4
S["M4_precision_k_positive"] = fxs(
    "select model, 3 as k, round(avg(num / 3.0), 6) as precision from (select p.model, p.doc_id, sum(case when t.doc_id is null then 0 "
    "else ceil(p.score) end) as num from (select * from (select model, doc_id, label_id, " + SIG + " as score, row_number() "
    "over (partition by model, doc_id order by score desc, label_id) as rank from fx_scores) a where rank <= 3) p "
    "left join fx_truth t on t.doc_id = p.doc_id and t.label_id = p.label_id group by p.model, p.doc_id) x group by model")


def _q_m5(spark, sf):
    pred = R.threshold_labels(fx_scores(spark, sf).withColumn("score", sigmoid("score")), 0.5)
    return M.f1_scores(pred, fx_truth(spark, sf), fx_labelmap(spark, sf), group_cols=["model"])


Q["M5_f1_scores"] = _q_m5
S["M5_f1_scores"] = fxs(
    "select model, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, "
    "round(case when 2 * sum(tp) + sum(fp) + sum(fn) > 0 then 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) "
    "else 0.0 end, 6) as micro_f1, round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) "
    "else 0.0 end), 6) as macro_f1 from (select mo.model, m.label_id, coalesce(x.tp, 0) as tp, coalesce(x.fp, 0) as fp, "
    "coalesce(x.fn, 0) as fn from fx_labelmap m cross join models mo left join (select coalesce(p.model, t.model) as model, "
    "coalesce(p.label_id, t.label_id) as label_id, "
    "sum(case when p.doc_id is not null and t.doc_id is not null then 1 else 0 end) as tp, "
    "sum(case when p.doc_id is not null and t.doc_id is null then 1 else 0 end) as fp, "
    "sum(case when p.doc_id is null and t.doc_id is not null then 1 else 0 end) as fn from (select model, doc_id, "
    f"label_id from fx_scores where {SIG} >= 0.5) p full outer join (select * from fx_truth cross join models) t "
    "on t.model = p.model and t.doc_id = p.doc_id and t.label_id = p.label_id group by 1, 2) x on x.label_id = m.label_id "
    "and x.model = mo.model) y group by model", [("models", "select distinct model from fx_scores")])


def _q_m7(spark, sf):
    ens = R.ensemble_sum(fx_scores(spark, sf))
    top = R.top_k(ens, 5, by=("model", "doc_id")).select("model", "doc_id", "label_id", "rank")
    truth = fx_truth(spark, sf)
    prf = M.prf_at_k(top, truth, (1, 2, 3), group_cols=["model"]).select("model", "k", "precision", "recall", "f1")
    p5 = M.precision_at(top, truth, (1, 3, 5), group_cols=["model"]).select(
        "model", "k", F.col("precision").alias("p_at"))
    return prf.join(p5, ["model", "k"], "full_outer").select(
        "model", F.col("k").cast("int").alias("k"), "precision", "recall", "f1", "p_at")


Q["M7_compare_models"] = _q_m7
S["M7_compare_models"] = fxs(
    "select coalesce(a.model, b.model) as model, coalesce(a.k, b.k) as k, a.precision, a.recall, a.f1, b.p_at from "
    "(select model, k, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / "
    "(p + r) else 0.0 end, 6) as f1 from (" + " union all ".join(
        f"select model, {k} as k, avg(h_{k} / {float(k)}) as p, avg(case when n_true > 0 then h_{k} / n_true end) as r "
        "from mperdoc group by model" for k in (1, 2, 3)) + ") x) a full outer join (" + " union all ".join(
        f"select model, {k} as k, round(sum(h_{k}) / count(*) / {float(k)}, 6) as p_at from mperdoc group by model"
        for k in (1, 3, 5)) + ") b on a.model = b.model and a.k = b.k",
    [("ens", f"select model, doc_id, label_id, {SIG} as s from fx_scores union all select 'all', doc_id, label_id, "
             f"sum({SIG}) from fx_scores group by doc_id, label_id"),
     ("etop", "select * from (select model, doc_id, label_id, row_number() over (partition by model, doc_id order by "
              "s desc, label_id) as rank from ens) x where rank <= 5"),
     ("ehits", "select p.model, p.doc_id, p.rank, case when t.doc_id is null then 0 else 1 end as hit from etop p "
               "left join fx_truth t on t.doc_id = p.doc_id and t.label_id = p.label_id"),
     NTRUE,
     ("mperdoc", "select h.model, h.doc_id, " + ", ".join(
         f"sum(case when rank <= {k} then hit else 0 end) as h_{k}" for k in (1, 2, 3, 5)) +
      ", coalesce(max(n.n_true), 0) as n_true from ehits h left join ntrue n using (doc_id) group by h.model, h.doc_id")])

# ------------------------------------------------------------------ vectors
LABEL_MEANS = ("lmeans", "select label, list(avg_x order by d) as w from (select label, d, avg(x) as avg_x from ("
                         "select label, unnest(cast(embedding as double[])) as x, unnest(generate_series(0, "
                         "len(embedding) - 1)) as d from embeddings) a group by label, d) b group by label")
KEYS = ("keys", "select cast(vec_id as varchar) as key, cast(embedding as double[]) as vec from embeddings "
                "where vec_id in (select min(vec_id) from embeddings group by label)")


def label_means(spark, sf):
    """Mean vector per embedding label (label-sized)."""
    v = fx_vectors(spark, sf)
    comps = v.select("label", F.posexplode("vec").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return comps.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))),
                                                  lambda s: s["x"]).alias("w"))


def _q_r4(spark, sf):
    w = label_means(spark, sf).select(F.col("label").cast("long").alias("label_id"), "w", F.lit(0.0).alias("bias"))
    vecs = fx_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")
    return V.linear_scores(vecs, w).select("doc_id", "label_id", F.round("score", 6).alias("score"))


Q["R4_linear_scores"] = _q_r4
S["R4_linear_scores"] = with_fx([], (
    "select e.vec_id as doc_id, cast(m.label as bigint) as label_id, round(list_dot_product(cast(e.embedding as "
    "double[]), m.w), 6) as score from embeddings e cross join lmeans m"), [LABEL_MEANS])


def _keys_queries(spark, sf):
    v = fx_vectors(spark, sf)
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    keys = v.join(first, ["label", "vec_id"], "left_semi").select(F.col("vec_id").cast("string").alias("key"), "vec")
    queries = v.join(first, ["label", "vec_id"], "left_anti").select(F.col("vec_id").cast("string").alias("query"), "vec")
    return keys, queries


def _q_r9(spark, sf):
    keys, queries = _keys_queries(spark, sf)
    return V.nearest_key(queries, keys).select("query", "nearest", F.round("sim", 6).alias("sim"))


Q["R9_nearest_key"] = _q_r9
S["R9_nearest_key"] = with_fx([], (
    "select query, key as nearest, round(sim, 6) as sim from (select cast(e.vec_id as varchar) as query, k.key, "
    "list_cosine_similarity(cast(e.embedding as double[]), k.vec) as sim, row_number() over (partition by e.vec_id "
    "order by round(list_cosine_similarity(cast(e.embedding as double[]), k.vec), 9) desc, k.key) as rn from embeddings e "
    "cross join keys k where cast(e.vec_id as varchar) not in (select key from keys)) x where rn = 1"), [KEYS])


def _groups_of_labels(spark, sf):
    return label_means(spark, sf).select(F.col("label").cast("string").alias("label"),
                                         (F.col("label") % 5).cast("long").alias("group_id"))


def _group_vectors(spark, sf):
    v = fx_vectors(spark, sf).withColumn("group_id", (F.col("label") % 5).cast("long"))
    comps = v.select("group_id", F.posexplode("vec").alias("d", "x")).groupBy("group_id", "d").agg(F.avg("x").alias("x"))
    return comps.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))),
                                                     lambda s: s["x"]).alias("w"))


def _group_scores(spark, sf):
    vecs = fx_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")
    w = _group_vectors(spark, sf).select(F.col("group_id").alias("label_id"), "w", F.lit(0.0).alias("bias"))
    return V.linear_scores(vecs, w).select("doc_id", F.col("label_id").alias("group_id"), "score")


def _q_r7(spark, sf):
    out = R.expand_groups(_group_scores(spark, sf), _groups_of_labels(spark, sf), 2)
    return out.select("doc_id", "label", "group_id", F.round("group_score", 6).alias("group_score"))


GROUP_CTES = [
    ("gmeans", "select group_id, list(avg_x order by d) as w from (select label % 5 as group_id, d, avg(x) as avg_x "
               "from (select label, unnest(cast(embedding as double[])) as x, unnest(generate_series(0, "
               "len(embedding) - 1)) as d from embeddings) a group by 1, 2) b group by group_id"),
    ("gscores", "select e.vec_id as doc_id, g.group_id, 1.0 / (1.0 + exp(-list_dot_product(cast(e.embedding as "
                "double[]), g.w))) as score from embeddings e cross join gmeans g"),
    ("gtop", "select * from (select *, row_number() over (partition by doc_id order by score desc, group_id) as rnk "
             "from gscores) x where rnk <= 2"),
    LABEL_MEANS,
    ("cands", "select t.doc_id, cast(m.label as varchar) as label, t.group_id, t.score as group_score from gtop t "
              "join lmeans m on m.label % 5 = t.group_id"),
]
Q["R7_expand_groups"] = _q_r7
S["R7_expand_groups"] = with_fx([], "select doc_id, label, cast(group_id as bigint) as group_id, "
                                    "round(group_score, 6) as group_score from cands", GROUP_CTES)


def _q_r8(spark, sf):
    cands = R.expand_groups(_group_scores(spark, sf), _groups_of_labels(spark, sf), 2)
    lv = label_means(spark, sf).select(F.col("label").cast("string").alias("label"), F.col("w").alias("vec"))
    dv = fx_vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "vec")
    out = R.rescore_candidates(cands, dv, lv, 3)
    return out.select("doc_id", "label", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


Q["R8_rescore_candidates"] = _q_r8
S["R8_rescore_candidates"] = with_fx([], (
    "select doc_id, label, rank, round(score, 6) as score from (select doc_id, label, score, row_number() over "
    "(partition by doc_id order by score desc, label) as rank from (select c.doc_id, c.label, 1.0 / (1.0 + "
    "exp(-list_dot_product(cast(e.embedding as double[]), m.w))) * c.group_score as score from cands c join "
    "embeddings e on e.vec_id = c.doc_id join lmeans m on cast(m.label as varchar) = c.label) x) y where rank <= 3"),
    GROUP_CTES)

# ------------------------------------------------------------- candidates
FX_BRAND_CTES = [("fxg", "select * from fx_groups")]


def _q_r12(spark, sf):
    return R.group_labels(fx_labels(spark, sf), fx_groups(spark, sf))


Q["R12_group_labels"] = _q_r12
S["R12_group_labels"] = with_fx(["fx_labels", "fx_groups"], (
    "select distinct l.doc_id, g.group_id from fx_labels l join fx_groups g using (label)"))


def _q_r11(spark, sf):
    out = R.sample_candidates(fx_labels(spark, sf), fx_groups(spark, sf), fx_groups(spark, sf), n=8, seed=7)
    return out.select("doc_id", "label", F.col("is_true").cast("boolean").alias("is_true"))


SEED_INT = "cast(('0x' || substr(md5({e}), 1, 8)) as bigint)"


def _sint(*parts):
    e = " || '|' || ".join(["'7'"] + [f"cast({p} as varchar)" for p in parts])
    return SEED_INT.format(e=e)


Q["R11_sample_candidates"] = _q_r11
def _r11_ctes(keep_positives: bool):
    order = "is_true desc, " if keep_positives else ""
    return [
        ("truth", "select distinct doc_id, label from fx_labels"),
        ("tg", "select distinct t.doc_id, g.group_id from truth t join fx_groups g using (label)"),
        ("pool", "select distinct tg.doc_id, g.label from tg join fx_groups g using (group_id)"),
        ("pool2", "select p.doc_id, p.label, t.doc_id is not null as is_true from pool p left join truth t "
                  "on t.doc_id = p.doc_id and t.label = p.label"),
        ("chosen", "select doc_id, label, " + ("is_true" if keep_positives else "false as is_true") + " from (select *, "
                   f"row_number() over (partition by doc_id order by {order}{_sint('doc_id', 'label')}, label) as r "
                   "from pool2) x where r <= 8"),
        ("nlab", "select count(*) as n from (select distinct label from fx_groups) x"),
        ("perm", "select label, row_number() over (order by " + _sint('label') + ", label) - 1 as p "
                 "from (select distinct label from fx_groups) x"),
        ("have", "select d.doc_id, coalesce(c.h, 0) as h from (select distinct doc_id from truth) d left join "
                 "(select doc_id, count(*) as h from chosen group by doc_id) c using (doc_id)"),
        ("slots", "select h.doc_id, h.h, j.j, (" + _sint('h.doc_id') + " + j.j) % (select n from nlab) as p from have h, "
                  "(select unnest(generate_series(0, least(8, (select n from nlab)) - 1)) as j) j "
                  "where h.h < least(8, (select n from nlab))"),
        ("fill", "select doc_id, label from (select s.doc_id, pm.label, s.h, row_number() over (partition by s.doc_id "
                 "order by s.j) as k from slots s join perm pm using (p) where not exists (select 1 from chosen c where "
                 "c.doc_id = s.doc_id and c.label = pm.label)) x where k <= least(8, (select n from nlab)) - h"),
        ("cands", "select doc_id, label, is_true from chosen union all select doc_id, label, false from fill"),
    ]


S["R11_sample_candidates"] = with_fx(["fx_labels", "fx_groups"], "select doc_id, label, is_true from cands",
                                     _r11_ctes(True))


def _q_r13(spark, sf):
    labels = write_and_read(fx_labels(spark, sf), "labels")
    cands = R.sample_candidates(labels, fx_groups(spark, sf), fx_groups(spark, sf), n=8, seed=7, keep_positives=False)
    slots = cands.select("doc_id", "label", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("label")).alias("slot"))
    out = R.best_candidates_targets(slots.select("doc_id", F.col("slot").cast("long").alias("slot"), "label"),
                                    labels)
    return out.select("doc_id", "slot", "label", F.col("target").cast("int").alias("target"))


Q["R13_best_candidates_targets"] = _q_r13
S["R13_best_candidates_targets"] = with_fx(["fx_labels", "fx_groups"], (
    "select f.doc_id, f.slot, coalesce(r.new_label, f.label) as label, cast(case when r.new_label is not null then 1 "
    "else f.target end as int) as target from flagged f left join repl r on r.doc_id = f.doc_id and r.slot = f.slot"),
    _r11_ctes(False) + [
        ("slotted", "select doc_id, cast(row_number() over (partition by doc_id order by label) as bigint) as slot, label "
                    "from cands"),
        ("flagged", "select s.doc_id, s.slot, s.label, case when t.doc_id is null then 0 else 1 end as target "
                    "from slotted s left join truth t on t.doc_id = s.doc_id and t.label = s.label"),
        ("missing", "select doc_id, label, row_number() over (partition by doc_id order by label) as k from truth t "
                    "where not exists (select 1 from slotted s where s.doc_id = t.doc_id and s.label = t.label)"),
        ("free", "select doc_id, slot, row_number() over (partition by doc_id order by slot) as k from flagged "
                 "where target = 0"),
        ("repl", "select f.doc_id, f.slot, m.label as new_label from free f join missing m on m.doc_id = f.doc_id "
                 "and m.k = f.k"),
    ])

QUERIES_RANK, ORACLE_RANK = Q, S
