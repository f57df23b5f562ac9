"""T1 registered queries: the streaming scorer and its batch twin, both with a SQL twin."""

from __future__ import annotations

import os



from vulnxml.plans.queries_text import D1_DOCS_CTES, TOKENS_SQL
from vulnxml.plans.queries_vocab import doc_split
from vulnxml.sources.fixtures import fx_doclabels, fx_labelmap, with_fx
from vulnxml.sources.formats import scratch_dir
from vulnxml.sources.tables import read_table
from vulnxml.streaming.score_stream import fit_centroids, pack_scorer, score_batch, score_stream


def _scorer(spark, sf):
    docs = read_table(spark, sf, "documents")
    train = docs.join(doc_split(spark, sf).filter("split = 'train'"), "doc_id")
    lmap = fx_labelmap(spark, sf)
    return pack_scorer(spark, fit_centroids(train, fx_doclabels(spark, sf), lmap), lmap)


def _q_stream(spark, sf):
    base = scratch_dir(spark, "stream")
    score_stream(spark, sf, _scorer(spark, sf), os.path.join(base, "sink"), os.path.join(base, "checkpoint"))
    return spark.read.parquet(os.path.join(base, "sink")).select("doc_id", "labels")


def _q_batch(spark, sf):
    return score_batch(read_table(spark, sf, "documents"), _scorer(spark, sf)).select("doc_id", "labels")


QUERIES_STREAM = {"T1_score_stream": _q_stream, "T1_score_batch": _q_batch}

_T1_CTES = D1_DOCS_CTES + [
    TOKENS_SQL,
    ("bk", "select doc_id, cast(('0x' || substr(md5(word), 1, 8)) as bigint) % 64 as d, count(*) as c "
           "from tokens group by 1, 2"),
    ("uv", "select doc_id, d, c / sqrt(sum(c * c) over (partition by doc_id)) as x from bk"),
    ("grid", "select t.doc_id, g.d from (select doc_id from dsplit where split = 'train') t "
             "cross join (select unnest(generate_series(0, 63)) as d) g"),
    ("cent", "select m.label_id, g.d, avg(coalesce(u.x, 0.0)) as w from grid g join fx_doclabels l "
             "on l.doc_id = g.doc_id join fx_labelmap m on m.label = l.label left join uv u on u.doc_id = g.doc_id "
             "and u.d = g.d group by 1, 2"),
    ("dots", "select u.doc_id, c.label_id, sum(u.x * c.w) as s from uv u join cent c using (d) group by 1, 2"),
    ("scored", "select d.doc_id, m.label_id, m.label, round(coalesce(t.s, 0.0), 9) as score from documents d "
               "cross join fx_labelmap m left join dots t on t.doc_id = d.doc_id and t.label_id = m.label_id"),
    ("t1rank", "select doc_id, label, row_number() over (partition by doc_id order by 1.0 / (1.0 + exp(-score)) desc, "
               "label_id) as r from scored"),
]
_T1_SQL = with_fx(["fx_doclabels", "fx_labelmap"], "select doc_id, string_agg(label, ',' order by r) as labels "
                                                   "from t1rank where r <= 3 group by doc_id", _T1_CTES)
ORACLE_STREAM: dict[str, str] = {"T1_score_stream": _T1_SQL, "T1_score_batch": _T1_SQL}

