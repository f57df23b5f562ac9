"""Registered queries for vocabularies, TF-IDF, sequences, word vectors,
label tables and splits, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vulnxml.functions.arrays import fit_length, multi_hot, strip_padding
from vulnxml.operators import labels as L
from vulnxml.operators import vectors as V
from vulnxml.operators import vocab as W
from vulnxml.operators.graph import doc_words, tfidf_edges
from vulnxml.operators.split import holdout, shuffle_docs, stratified_split, tail_validation, use_given_split
from vulnxml.operators.text_ops import select_split, tokenize
from vulnxml.plans.queries_text import D1_DOCS_CTES, TOKENS_SQL, words_sql
from vulnxml.sources.fixtures import fx_doclabels, fx_labelmap, fx_labels, fx_truth, fx_vectors, with_fx
from vulnxml.sources.tables import read_table

Q, S = {}, {}
# Fixed fixture values for the equal-label check (FX-PAIRS).
COPIED_LABELS = ("Brand#11", "Brand#23")
COPY_SUFFIX = "-copy"
EMPTY_LABELS = ("zz-empty-1", "zz-empty-2")


def docs(spark, sf):
    return read_table(spark, sf, "documents")


def doc_split(spark, sf):
    return stratified_split(docs(spark, sf).select("doc_id"), fx_doclabels(spark, sf), 1, 5, 42)


def dsql(body, extra=None):
    return with_fx(["fx_doclabels"], body, D1_DOCS_CTES + (extra or []))


# ------------------------------------------------------------ TF-IDF, vocab
TT = ("tt", "select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) as term "
            "from documents")
MODEL = ("model", "select term, cast(row_number() over (order by term) - 1 as bigint) as term_id, df, "
                  "ln((1.0 + n) / (1.0 + df)) + 1 as idf from (select term, count(distinct doc_id) as df from tt "
                  "where doc_id in (select doc_id from dsplit where split = 'train') group by term) a, "
                  "(select count(*) as n from dsplit where split = 'train') b")


def _model(spark, sf):
    train = docs(spark, sf).join(doc_split(spark, sf).filter("split = 'train'"), "doc_id")
    return W.tfidf_fit(train)


Q["A8_tfidf_fit"] = lambda spark, sf: _model(spark, sf).select(
    "term", F.col("term_id").cast("bigint").alias("term_id"), "df", F.round("idf", 6).alias("idf"))
S["A8_tfidf_fit"] = dsql("select term, term_id, cast(df as bigint) as df, round(idf, 6) as idf from model", [TT, MODEL])

Q["A9_tfidf_transform"] = lambda spark, sf: W.tfidf_transform(docs(spark, sf), _model(spark, sf)).select(
    "doc_id", F.col("term_id").cast("bigint").alias("term_id"), F.round("weight", 6).alias("weight"))
S["A9_tfidf_transform"] = dsql(
    "select doc_id, term_id, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from "
    "(select t.doc_id, m.term_id, count(*) * max(m.idf) as w from tt t join model m using (term) "
    "group by t.doc_id, m.term_id) x", [TT, MODEL])

Q["A4_word_doc_freq"] = lambda spark, sf: W.word_doc_freq(tokenize(docs(spark, sf)))
S["A4_word_doc_freq"] = with_fx([], "select word, count(*) as word_freq, count(distinct doc_id) as doc_freq "
                                    "from tokens group by word", [TOKENS_SQL])


def _q_a10(spark, sf):
    e = tfidf_edges(doc_words(docs(spark, sf))).withColumnRenamed("word", "term")
    n = W.l2_normalize(e)
    return n.select("doc_id", "term", F.round("weight", 6).alias("weight"))


Q["A10_l2_normalize"] = _q_a10
S["A10_l2_normalize"] = with_fx([], (
    "select doc_id, word as term, round(case when nr > 0 then w / nr else w end, 6) as weight from (select *, sqrt(sum(w * w) over (partition by doc_id)) as nr from (select t.doc_id, t.word, "
    "t.tf * ln((select count(*) from documents) / d.df) as w from (select doc_id, word, count(*) as tf from tokens "
    "group by doc_id, word) t join (select word, count(distinct doc_id) as df from tokens group by word) d "
    "using (word)) a) b"), [TOKENS_SQL])

LT = ("lt", "select doc_id, unnest(ws) as word, unnest(generate_series(0, len(ws) - 1)) as pos from (select doc_id, "
            + words_sql("lower(coalesce(text, ''))") + " as ws from documents) x")
VOCAB_ALL = ("vocab", "select '<unk>' as word, 0 as word_id, 0 as freq union all select '<pad>', 1, 0 union all "
                      "select word, row_number() over (order by count(*) desc, word) + 1, count(*) from lt group by word")
VOCAB_TRAIN = ("vocab", "select '<unk>' as word, 0 as word_id, 0 as freq union all select '<pad>', 1, 0 union all "
                        "select word, row_number() over (order by count(*) desc, word) + 1, count(*) from lt "
                        "where doc_id in (select doc_id from dsplit where split = 'train') group by word")

Q["A16_build_vocab"] = lambda spark, sf: W.build_vocab(W.lower_tokens(docs(spark, sf))).select(
    "word", F.col("word_id").cast("bigint").alias("word_id"), F.col("freq").cast("bigint").alias("freq"))
S["A16_build_vocab"] = with_fx([], "select word, cast(word_id as bigint) as word_id, cast(freq as bigint) as freq "
                                   "from vocab", [LT, VOCAB_ALL])


def _ids(spark, sf):
    d = docs(spark, sf)
    train = d.join(doc_split(spark, sf).filter("split = 'train'"), "doc_id")
    vocab = W.build_vocab(W.lower_tokens(train))
    return W.lookup_vocab(W.lower_tokens(d), vocab)


Q["J5_lookup_vocab"] = lambda spark, sf: _ids(spark, sf).select(
    "doc_id", F.col("pos").cast("bigint").alias("pos"), "word", "word_id")
IDS = ("ids", "select lt.doc_id, lt.pos, lt.word, coalesce(v.word_id, 0) as word_id from lt left join vocab v using (word)")
S["J5_lookup_vocab"] = dsql("select doc_id, cast(pos as bigint) as pos, word, cast(word_id as bigint) as word_id "
                            "from ids", [LT, VOCAB_TRAIN, IDS])

Q["Q3_fix_length_tokens"] = lambda spark, sf: W.fix_length_tokens(_ids(spark, sf), docs(spark, sf), 500).select(
    "doc_id", F.array_join("ids", ",").alias("ids"))
SEQ = ("seq", "select d.doc_id, coalesce(s.ids, []) as ids from documents d left join (select doc_id, "
              "list(word_id order by pos) as ids from ids group by doc_id) s using (doc_id)")
S["Q3_fix_length_tokens"] = dsql(
    "select doc_id, array_to_string(list_concat(ids[1:500], list_transform(generate_series(1, 500 - len(ids[1:500])), "
    "lambda x: 1)), ',') as ids from seq", [LT, VOCAB_TRAIN, IDS, SEQ])


def _seq(spark, sf):
    ids = _ids(spark, sf)
    return docs(spark, sf).select("doc_id").join(W.doc_sequences(ids), "doc_id", "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<long>")))


def _q_q1(spark, sf):
    f = _seq(spark, sf).select("doc_id", fit_length("ids", 128).alias("f"))
    return f.select("doc_id", F.array_join("f.input_ids", ",").alias("input_ids"),
                    F.aggregate("f.attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_real"),
                    F.size("f.token_type_ids").cast("bigint").alias("n_types"))


FIT = ("fit", "select doc_id, case when len(ids) > 128 then list_concat(ids[1:127], [ids[len(ids)]]) else "
              "list_concat(ids, list_transform(generate_series(1, 128 - len(ids)), lambda x: 0)) end as input_ids, "
              "least(len(ids), 128) as n_real from seq")
Q["Q1_fit_length"] = _q_q1
S["Q1_fit_length"] = dsql("select doc_id, array_to_string(input_ids, ',') as input_ids, cast(n_real as bigint) as "
                          "n_real, cast(128 as bigint) as n_types from fit", [LT, VOCAB_TRAIN, IDS, SEQ, FIT])


def _q_q2(spark, sf):
    f = _seq(spark, sf).select("doc_id", fit_length("ids", 128).alias("f"))
    return f.select("doc_id", F.array_join(strip_padding("f.input_ids"), ",").alias("ids"))


Q["Q2_strip_padding"] = _q_q2
S["Q2_strip_padding"] = dsql(
    "select doc_id, array_to_string(case when input_ids[len(input_ids)] = 0 then list_filter(input_ids, "
    "lambda x: x <> 0) else input_ids end, ',') as ids from fit", [LT, VOCAB_TRAIN, IDS, SEQ, FIT])


def _q_a17(spark, sf):
    n = fx_labelmap(spark, sf).count()  # label-sized scalar
    ids = fx_truth(spark, sf).groupBy("doc_id").agg(F.collect_list("label_id").alias("ids"))
    return ids.select("doc_id", F.array_join(multi_hot("ids", n), "").alias("vec"))


Q["A17_multi_hot"] = _q_a17
S["A17_multi_hot"] = with_fx(["fx_truth"], (
    "select doc_id, array_to_string(list_transform(generate_series(0, (select count(*) from fx_labelmap) - 1), "
    "lambda i: case when list_contains(ids, i) then 1 else 0 end), '') as vec from (select doc_id, list(label_id) "
    "as ids from fx_truth group by doc_id) x"))


def _word_vectors(spark, sf):
    vocab = W.build_vocab(W.lower_tokens(docs(spark, sf)))
    return vocab.join(fx_vectors(spark, sf).select(F.col("vec_id").alias("word_id"), "vec"), "word_id").select(
        "word", "vec")


def _q_a18(spark, sf):
    # Dealt out by doc, so that words are counted where they lie.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs(spark, sf).select("doc_id", "text").repartition(parts, "doc_id")
    mv = V.mean_vectors(W.lower_tokens(dealt), _word_vectors(spark, sf), 64)
    return mv.select("doc_id", F.posexplode("vec").alias("d", "value")).select(
        "doc_id", F.col("d").cast("bigint").alias("d"), F.round("value", 6).alias("value"))


WV = ("wv", "select v.word, cast(e.embedding as double[]) as vec from vocab v join embeddings e on e.vec_id = v.word_id")
Q["A18_mean_vectors"] = _q_a18
S["A18_mean_vectors"] = with_fx([], (
    "select n.doc_id, cast(dd.d as bigint) as d, round(coalesce(s.sx, 0.0) / n.n, 6) as value from "
    "(select doc_id, count(*) as n from lt group by doc_id) n cross join (select unnest(generate_series(0, 63)) as d) dd "
    "left join (select lt.doc_id, x.d, sum(x.x) as sx from lt join (select word, unnest(vec) as x, "
    "unnest(generate_series(0, len(vec) - 1)) as d from wv) x using (word) group by lt.doc_id, x.d) s "
    "on s.doc_id = n.doc_id and s.d = dd.d"), [LT, VOCAB_ALL, WV])


def _q_j10(spark, sf):
    vocab = W.build_vocab(W.lower_tokens(docs(spark, sf)))
    out = V.attach_vectors(vocab, _word_vectors(spark, sf), 64)
    return out.select(F.col("word_id").cast("bigint").alias("word_id"), "word",
                      F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


Q["J10_attach_vectors"] = _q_j10
S["J10_attach_vectors"] = with_fx([], (
    "select cast(v.word_id as bigint) as word_id, v.word, coalesce(list_transform(w.vec, lambda x: round(x, 6)), "
    "list_transform(generate_series(1, 64), lambda i: cast(0 as double))) as vec from vocab v left join wv w using (word)"), [LT, VOCAB_ALL, WV])

# ------------------------------------------------------------------ labels
def fx_pairs(spark, sf):
    """FX-PAIRS: (report_labels, label_names) for the equal-label check."""
    base = fx_labels(spark, sf).select(F.col("doc_id").alias("report_id"), "label")
    copies = base.filter(F.col("label").isin(*COPIED_LABELS)).select(
        "report_id", F.concat("label", F.lit(COPY_SUFFIX)).alias("label"))
    rl = base.unionByName(copies)
    names = rl.select("label").distinct().unionByName(
        spark.createDataFrame([(x,) for x in EMPTY_LABELS], "label string"))
    names = names.withColumn("position", F.row_number().over(Window.orderBy("label")).cast("bigint"))
    return rl, names


PAIR_CTES = [
    ("rl", "select doc_id as report_id, label from fx_labels union all select doc_id, label || '-copy' from fx_labels "
           "where label in ('Brand#11', 'Brand#23')"),
    ("hdr", "select label, row_number() over (order by label) as position from (select distinct label from rl union "
            "select 'zz-empty-1' union select 'zz-empty-2') x"),
    ("fp", "select h.label, h.position, coalesce(string_agg(cast(r.report_id as varchar), ',' order by r.report_id), "
           "'') as fp from hdr h left join (select distinct report_id, label from rl) r using (label) "
           "group by h.label, h.position"),
    ("heads", "select fp, arg_min(label, position) as head from fp group by fp"),
    ("pairs", "select heads.head, fp.label from fp join heads using (fp) where fp.label <> heads.head"),
]


def _q_a11(spark, sf):
    rl, names = fx_pairs(spark, sf)
    return L.find_equal_labels(rl, names)


Q["A11_find_equal_labels"] = _q_a11
S["A11_find_equal_labels"] = with_fx(["fx_labels"], "select head, label from pairs", PAIR_CTES)


def _q_a12(spark, sf):
    rl, names = fx_pairs(spark, sf)
    return L.merge_equal_labels(rl, L.find_equal_labels(rl, names), names)


Q["A12_merge_equal_labels"] = _q_a12
S["A12_merge_equal_labels"] = with_fx(["fx_labels"], (
    "select distinct r.report_id, coalesce(m.merged, r.label) as label from rl r left join (select mm.label, n.merged "
    "from (select head, label from pairs union select head, head from pairs) mm join (select head, string_agg(label, "
    "';' order by position) as merged from (select p.head, p.label, h.position from (select head, label from pairs "
    "union select head, head from pairs) p join hdr h on h.label = p.label) z group by head) n using (head)) m "
    "using (label)"), PAIR_CTES)


def _q_a13(spark, sf):
    rl, names = fx_pairs(spark, sf)
    return L.zero_support_labels(rl, names)


Q["A13_zero_support_labels"] = _q_a13
S["A13_zero_support_labels"] = with_fx(["fx_labels"], "select label from hdr where label not in (select label from rl)",
                                       PAIR_CTES)

Q["A14_label_map"] = lambda spark, sf: L.label_map(fx_doclabels(spark, sf))
S["A14_label_map"] = with_fx(["fx_labelmap"], "select label, label_id from fx_labelmap")


def _q_a15(spark, sf):
    return L.corpus_summary(doc_split(spark, sf), fx_doclabels(spark, sf))


Q["A15_corpus_summary"] = _q_a15
S["A15_corpus_summary"] = dsql(
    "select 'docs_' || split as metric, count(*) as value from dsplit group by split union all "
    "select 'labels_train', count(distinct label) from fx_doclabels join dsplit using (doc_id) where split = 'train' "
    "union all select 'labels_all', count(distinct label) from fx_doclabels join dsplit using (doc_id) union all "
    "select 'labels_test_only', count(*) from (select distinct label from fx_doclabels join dsplit using (doc_id) "
    "where split = 'test' except select distinct label from fx_doclabels join dsplit using (doc_id) "
    "where split = 'train') x")


def _q_j2(spark, sf):
    lab = read_table(spark, sf, "labels")
    lists = lab.select(F.col("doc_id").alias("report_id"), F.concat_ws(
        ",", F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")).alias("labels"))
    reports = docs(spark, sf).select(F.col("doc_id").alias("report_id"))
    return L.attach_labels(reports, lists).select("report_id", F.array_join("labels", " ").alias("labels"))


Q["J2_attach_labels"] = _q_j2
S["J2_attach_labels"] = (
    "select d.doc_id as report_id, coalesce(array_to_string(list_filter(string_split(l.labels, ','), "
    "lambda x: x <> ''), ' '), '') as labels from documents d left join (select doc_id, min(concat_ws(',', "
    "case when quality = 1 then 'quality' end, case when toxic = 1 then 'toxic' end)) as labels from labels "
    "group by doc_id) l on l.doc_id = d.doc_id")


def _q_j4(spark, sf):
    lm = fx_labelmap(spark, sf)
    enc = L.encode_labels(fx_doclabels(spark, sf), lm)
    return L.decode_labels(enc, lm).select("doc_id", "label")


Q["J4_encode_decode_labels"] = _q_j4
S["J4_encode_decode_labels"] = with_fx(["fx_labelmap"], (
    "select t.doc_id, m.label from (select d.doc_id, m.label_id from fx_doclabels d join fx_labelmap m using (label)) t "
    "join fx_labelmap m using (label_id)"))

# ------------------------------------------------------------------ splits
Q["D1_stratified_split_docs"] = lambda spark, sf: doc_split(spark, sf)
S["D1_stratified_split_docs"] = dsql("select doc_id, split from dsplit")

Q["D2_holdout"] = lambda spark, sf: holdout(doc_split(spark, sf), 400, 1240).select("doc_id", "split")
S["D2_holdout"] = dsql(
    "select s.doc_id, case when h.doc_id is not null then 'valid' else s.split end as split from dsplit s left join "
    "(select doc_id from dsplit where split = 'train' order by md5('1240|' || cast(doc_id as varchar)), doc_id "
    "limit 400) h using (doc_id)")


def _q_d4(spark, sf):
    sh = shuffle_docs(doc_split(spark, sf), 42)
    return tail_validation(sh, 0.1).select("doc_id", "split", F.col("doc_index").cast("bigint").alias("doc_index"))


Q["D4_tail_validation"] = _q_d4
S["D4_tail_validation"] = dsql(
    "select doc_id, case when split = 'train' and doc_index >= (select count(*) - floor(count(*) * 0.1) from shuffled "
    "where split = 'train') then 'valid' else split end as split, doc_index from shuffled")


def _q_j9(spark, sf):
    train = docs(spark, sf).select("doc_id", "text")
    test = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return use_given_split(train, test).select("doc_id", "split", "text")


Q["J9_union_splits"] = _q_j9
S["J9_union_splits"] = "select doc_id, 'train' as split, text from documents union all select item_id, 'test', text from benchmark"

def _q_d5(spark, sf):
    sp = doc_split(spark, sf)
    train = sp.filter("split = 'train'").select("doc_id")
    test = sp.filter("split = 'test'").select("doc_id")
    return use_given_split(train, test).select("doc_id", "split")


Q["D5_use_given_split"] = _q_d5
S["D5_use_given_split"] = dsql("select doc_id, split from dsplit")

Q["P16_select_split"] = lambda spark, sf: select_split(doc_split(spark, sf), "test").select("doc_id")
S["P16_select_split"] = dsql("select doc_id from dsplit where split = 'test'")

QUERIES_VOCAB, ORACLE_VOCAB = Q, S
