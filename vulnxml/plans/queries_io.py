"""Registered round-trip queries for the file formats (I1-I16): each writes
Spark-derived data to a fresh folder under the shared checkpoint dir and
reads it back with the matching reader."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from vulnxml.operators.labels import find_equal_labels, label_pair_lines, parse_label_pair_lines
from vulnxml.operators import vocab as W
from vulnxml.plans.queries_text import D1_DOCS_CTES, GRAPH_EDGE_CTES, SQL_TRIM_SET
from vulnxml.plans.queries_vocab import (LT, MODEL, TT, VOCAB_ALL, WV, _word_vectors, doc_split, fx_pairs,
                                         PAIR_CTES)
from vulnxml.sources import formats as IO
from vulnxml.sources.fixtures import fx_cpe, fx_doclabels, fx_labelmap, fx_scores, fx_truth, with_fx
from vulnxml.sources.tables import read_table, table_path

Q, S = {}, {}


def docs(spark, sf):
    return read_table(spark, sf, "documents")


def _labels_array(spark, sf):
    return fx_doclabels(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def _q_svmlight(spark, sf):
    d = docs(spark, sf)
    counts = W.doc_terms(d)
    model = W.tfidf_fit(counts.join(doc_split(spark, sf).filter("split = 'train'"), "doc_id"))
    feats = W.tfidf_transform(counts, model)
    path = IO.scratch_dir(spark, "svmlight")
    IO.write_svmlight(feats, fx_truth(spark, sf), path)
    back = IO.read_svmlight(spark, path)
    return back.select(F.col("doc_id").alias("line_no"), F.array_join("labels", ",").alias("labels"),
                       F.col("idx").cast("bigint").alias("idx"), F.round("val", 6).alias("val"))


Q["I5_I6_svmlight_roundtrip"] = _q_svmlight
S["I5_I6_svmlight_roundtrip"] = with_fx(["fx_doclabels", "fx_truth"], (
    "select d.line_no, coalesce(l.labels, '') as labels, f.term_id as idx, round(f.weight, 6) as val from (select doc_id, "
    "cast(row_number() over (order by doc_id) - 1 as bigint) as line_no from (select doc_id from fx_truth union select "
    "doc_id from feats) u) d left join (select doc_id, string_agg(cast(label_id as varchar), ',' order by label_id) as "
    "labels from fx_truth group by doc_id) l using (doc_id) left join feats f using (doc_id)"),
    D1_DOCS_CTES + [TT, MODEL, ("feats", "select doc_id, term_id, w / sqrt(sum(w * w) over (partition by doc_id)) as "
                                         "weight from (select t.doc_id, m.term_id, count(*) * max(m.idf) as w from tt t "
                                         "join model m using (term) group by t.doc_id, m.term_id) x")])


def _q_lines(spark, sf):
    corpus = docs(spark, sf).join(doc_split(spark, sf), "doc_id").join(_labels_array(spark, sf), "doc_id", "left")
    out = IO.scratch_dir(spark, "lines")
    parts = []
    for split in ("train", "test"):
        IO.write_text_label_lines(corpus, out, split)
        parts.append(IO.read_parallel_lines(spark, os.path.join(out, f"{split}_texts.txt"),
                                            os.path.join(out, f"{split}_labels.txt"), split))
    return parts[0].unionByName(parts[1]).select("line_no", "split", "text", F.array_join("labels", " ").alias("labels"))


Q["I7_I2_line_files_roundtrip"] = _q_lines
S["I7_I2_line_files_roundtrip"] = with_fx(["fx_doclabels"], (
    "select cast(row_number() over (partition by s.split order by d.doc_id) - 1 as bigint) as line_no, s.split, "
    f"trim(replace(replace(coalesce(d.text, ''), chr(10), ''), chr(13), ''), {SQL_TRIM_SET}) as text, "
    " coalesce(l.labels, '') as labels from documents d "
    "join dsplit s using (doc_id) left join (select doc_id, string_agg(label, ' ' order by label) as labels from "
    "fx_doclabels group by doc_id) l using (doc_id)"), D1_DOCS_CTES)


def _q_label_lists(spark, sf):
    path = IO.scratch_dir(spark, "labellists")
    IO.write_label_lists(fx_doclabels(spark, sf).withColumnRenamed("doc_id", "report_id"), path)
    return IO.read_label_lists(spark, path).select(F.col("report_id").cast("bigint").alias("report_id"),
                                                   F.col("pos").cast("bigint").alias("pos"), "label")


Q["I3_label_lists_roundtrip"] = _q_label_lists
S["I3_label_lists_roundtrip"] = with_fx(["fx_doclabels"], (
    "select doc_id as report_id, cast(row_number() over (partition by doc_id order by label) - 1 as bigint) as pos, "
    "label from fx_doclabels"))


def _q_cve_json(spark, sf):
    cp = fx_cpe(spark, sf).groupBy("report_id").agg(F.array_sort(F.collect_list("cpe")).alias("cpes"))
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("report_id"), "url")
    d = docs(spark, sf).select(F.col("doc_id").alias("report_id"), "text")
    rec = d.join(cp, "report_id", "left").join(pages, "report_id", "left")
    match = lambda arr: F.transform(F.coalesce(arr, F.array().cast("array<string>")),
                                    lambda c: F.struct(c.alias("cpe23Uri")))
    item = F.struct(
        F.struct(F.struct(F.array(F.struct(F.col("text").alias("value"))).alias("description_data"))
                 .alias("description"),
                 F.struct(F.when(F.col("url").isNull(), F.array()).otherwise(F.array(F.struct(F.col("url").alias("url"))))
                          .alias("reference_data")).alias("references")).alias("cve"),
        F.struct(F.array(F.struct(match(F.col("cpes")).alias("cpe_match"),
                                  F.array(F.struct(match(F.reverse("cpes")).alias("cpe_match"))).alias("children")))
                 .alias("nodes")).alias("configurations"))
    path = IO.scratch_dir(spark, "cvejson")
    rec.select(F.col("report_id").cast("string").alias("id"),
               F.struct(F.array(item).alias("CVE_Items")).alias("result")).write.mode("overwrite").json(path)
    back = IO.read_cve_json(spark, path)
    return back.select(F.col("report_id").cast("bigint").alias("report_id"),
                       "description",
                       F.array_join("cpes", "|").alias("cpes"), F.array_join("urls", "|").alias("urls"))


Q["I4_read_cve_json"] = _q_cve_json
S["I4_read_cve_json"] = with_fx(["fx_cpe"], (
    "select d.doc_id as report_id, coalesce(d.text, '') as description, "
    "coalesce(c.fwd || case when c.fwd <> '' then '|' else '' end || c.rev, '') as cpes, coalesce(p.url, '') as urls "
    "from documents d left join (select report_id, string_agg(cpe, '|' order by cpe) as fwd, string_agg(cpe, '|' "
    "order by cpe desc) as rev from fx_cpe group by report_id) c on c.report_id = d.doc_id left join pages p "
    "on p.page_id = d.doc_id"))


def _q_prefixed(spark, sf):
    corpus = docs(spark, sf).join(_labels_array(spark, sf), "doc_id", "left")
    order = fx_labelmap(spark, sf).select("label", F.col("label_id").alias("position"))
    path = IO.scratch_dir(spark, "prefixed")
    IO.write_prefixed_lines(corpus, order, path)
    return IO.with_line_numbers(spark.read.text(path)).select("line_no", F.col("value").alias("line"))


Q["I8_prefixed_lines"] = _q_prefixed
S["I8_prefixed_lines"] = with_fx(["fx_labelmap"], (
    "select cast(row_number() over (order by d.doc_id) - 1 as bigint) as line_no, coalesce(p.pref, '') || "
    f"ltrim(replace(replace(coalesce(d.text, ''), chr(10), ''), chr(13), ''), {SQL_TRIM_SET}) as line from documents d left join "
    "(select l.doc_id, string_agg('__label__' || l.label || ' ', '' order by m.label_id) as pref from fx_doclabels l "
    "join fx_labelmap m using (label) group by l.doc_id) p using (doc_id)"))


def _q_title_tags(spark, sf):
    lt = fx_doclabels(spark, sf).groupBy("doc_id").agg(F.concat(F.lit("['"), F.array_join(
        F.array_sort(F.collect_list("label")), "', '"), F.lit("']")).alias("label_text"))
    corpus = docs(spark, sf).join(lt, "doc_id", "left")
    path = IO.scratch_dir(spark, "titletags")
    IO.write_title_tags_json(corpus, path)
    back = IO.with_line_numbers(spark.read.text(path)).select(
        "line_no", F.from_json("value", "title string, tags array<string>").alias("r"))
    return back.select("line_no", F.col("r.title").alias("title"), F.array_join("r.tags", "|").alias("tags"))


Q["I9_title_tags_json"] = _q_title_tags
S["I9_title_tags_json"] = with_fx(["fx_doclabels"], (
    "select cast(row_number() over (order by d.doc_id) - 1 as bigint) as line_no, "
    f"trim(coalesce(d.text, ''), {SQL_TRIM_SET}) as title, "
    "coalesce(l.tags, '') as tags from documents d left join (select doc_id, "
    "string_agg(replace(label, ' ', ''), '|' order by label) as tags from fx_doclabels group by doc_id) l "
    "using (doc_id)"))


def _q_tsv(spark, sf):
    corpus = docs(spark, sf).join(doc_split(spark, sf), "doc_id").join(_labels_array(spark, sf), "doc_id", "left")
    out = IO.scratch_dir(spark, "tsv")
    IO.write_id_labels_text_tsv(corpus.select("doc_id", "text", "split", "labels"), out)
    parts = [IO.read_id_labels_text_tsv(spark, os.path.join(out, f"{s}.txt")).withColumn("split", F.lit(s))
             for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("split", F.col("id").cast("bigint").alias("doc_id"), F.array_join("labels", " ").alias("labels"),
                       F.coalesce("text", F.lit("")).alias("text"))


Q["I10_tsv_roundtrip"] = _q_tsv
S["I10_tsv_roundtrip"] = with_fx(["fx_doclabels"], (
    "select case when v.doc_id is not null then 'valid' else s.split end as split, d.doc_id, coalesce(l.labels, '') as "
    "labels, translate(coalesce(d.text, ''), chr(9) || chr(13) || chr(10), '   ') as text from documents d join dsplit s "
    "using (doc_id) left join (select doc_id, string_agg(label, ' ' order by label) as labels from fx_doclabels group by "
    "doc_id) l using (doc_id) left join (select doc_id from dsplit where split = 'train' order by md5('42|' || "
    "cast(doc_id as varchar)), doc_id limit (select count(*) // 4 from dsplit where split = 'train')) v "
    "on v.doc_id = d.doc_id"), D1_DOCS_CTES)


def _q_predictions(spark, sf):
    path = IO.scratch_dir(spark, "predictions")
    IO.write_predictions(fx_scores(spark, sf), path)
    back = IO.read_predictions(spark, path)
    return back.select("model", "doc_id", "label_id", F.round("score", 6).alias("score"))


Q["I12_predictions_roundtrip"] = _q_predictions
S["I12_predictions_roundtrip"] = with_fx(["fx_scores"], "select model, doc_id, label_id, round(score, 6) as score "
                                                        "from fx_scores")


def _q_pairs_lines(spark, sf):
    rl, names = fx_pairs(spark, sf)
    path = IO.scratch_dir(spark, "pairs")
    label_pair_lines(find_equal_labels(rl, names)).write.mode("overwrite").text(path)
    return parse_label_pair_lines(spark.read.text(path))


Q["I13_label_pairs_roundtrip"] = _q_pairs_lines
S["I13_label_pairs_roundtrip"] = with_fx(["fx_labels"], "select head, label from pairs", PAIR_CTES)


def _q_word_vectors(spark, sf):
    path = IO.scratch_dir(spark, "wordvec")
    IO.word_vector_lines(_word_vectors(spark, sf)).write.mode("overwrite").text(path)
    back = IO.read_word_vectors(spark, path)
    return back.select("word", F.posexplode("vec").alias("d", "x")).select(
        "word", F.col("d").cast("bigint").alias("d"), F.round("x", 6).alias("x"))


Q["I14_word_vectors_roundtrip"] = _q_word_vectors
S["I14_word_vectors_roundtrip"] = with_fx([], "select word, cast(unnest(generate_series(0, len(vec) - 1)) as "
                                              "bigint) as d, round(unnest(vec), 6) as x from wv", [LT, VOCAB_ALL, WV])


def _q_pages(spark, sf):
    return IO.read_pages(spark, table_path(sf, "pages")).select("page_id", "url", "html")


Q["I16_read_pages"] = _q_pages
S["I16_read_pages"] = "select page_id, url, html from pages"

QUERIES_IO, ORACLE_IO = Q, S


def _q_wide_csv(spark, sf):
    rl = fx_doclabels(spark, sf).select(F.col("doc_id").cast("string").alias("report_id"), "label")
    names = [r["label"] for r in fx_labelmap(spark, sf).orderBy("label_id").collect()]  # label-sized header
    reports = docs(spark, sf).select(F.col("doc_id").cast("string").alias("report_id"),
                                     F.col("text").alias("description"))
    path = IO.scratch_dir(spark, "widecsv")
    IO.write_reports_wide(reports, rl, names, path)
    rep, back, header = IO.read_reports_wide(spark, path, "report_id", ["description"], ["report_id", "description"],
                                            multi_line=False)
    lists = back.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return rep.join(lists, "report_id", "left").select(
        F.col("report_id").cast("bigint").alias("doc_id"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("labels", F.lit("")).alias("labels"))


QUERIES_IO["I1_reports_wide_roundtrip"] = _q_wide_csv
ORACLE_IO["I1_reports_wide_roundtrip"] = with_fx(["fx_doclabels"], (
    "select d.doc_id, translate(coalesce(d.text, ''), chr(13) || chr(10), '  ') as description, coalesce(l.labels, '') as "
    "labels from documents d left join (select doc_id, string_agg(label, ',' order by label) as labels from fx_doclabels "
    "group by doc_id) l using (doc_id)"))


def _q_records(spark, sf):
    ids = fx_truth(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list("label_id")).alias("label_ids"))
    corpus = docs(spark, sf).select("doc_id", "text").join(ids, "doc_id")
    path = IO.scratch_dir(spark, "records")
    IO.write_text_category_records(corpus, path)
    back = spark.read.parquet(path)
    return back.select("doc_id", "text", F.array_join("catgy", ",").alias("catgy"))


QUERIES_IO["I11_text_category_records"] = _q_records
ORACLE_IO["I11_text_category_records"] = with_fx(["fx_truth"], (
    "select d.doc_id, d.text, t.catgy from documents d join (select doc_id, "
    "array_to_string(list_sort(list(label_id)), ',') as catgy from fx_truth group by doc_id) t using (doc_id)"))


def _q_graph_files(spark, sf):
    from vulnxml.operators import graph as G
    from vulnxml.operators.split import shuffle_docs
    sh = shuffle_docs(doc_split(spark, sf), 42)
    dw = G.doc_words(docs(spark, sf), dealt=True).join(sh, "doc_id")
    nodes, edges = G.assemble_graph(dw)
    out = IO.scratch_dir(spark, "graph")
    IO.write_graph(nodes, edges, out)
    IO.write_graph_lists(spark.read.parquet(os.path.join(out, "nodes")), fx_labelmap(spark, sf), out)

    def back(name):
        return spark.read.parquet(os.path.join(out, name))
    lists = [back("nodes").select(F.lit("nodes").alias("part"), "name", "kind", "node_id"),
             back("vocab").select(F.lit("vocab"), "word", F.lit("word"), "node_id"),
             back("labels").select(F.lit("labels"), "label", F.lit("label"), "label_id")]
    lists += [back(f"{s}_ids").select(F.lit(f"{s}_ids"), F.col("doc_id").cast("string"), F.lit(f"{s}_doc"), "node_id")
              for s in ("train", "test")]
    out_rows = lists[0]
    for part in lists[1:]:
        out_rows = out_rows.union(part)
    edges_back = back("edges").groupBy("src", "kind").agg(F.count(F.lit(1)).cast("bigint").alias("n_edges")).select(
        F.lit("edges"), F.col("src").cast("string"), "kind", "n_edges")
    return out_rows.union(edges_back).select("part", "name", "kind", F.col("node_id").cast("bigint").alias("value"))


QUERIES_IO["I15_write_graph"] = _q_graph_files
ORACLE_IO["I15_write_graph"] = with_fx(["fx_doclabels", "fx_labelmap"], (
    "select 'nodes' as part, name, kind, cast(node_id as bigint) as value from nodes union all "
    "select 'vocab', name, kind, node_id from nodes where kind = 'word' union all "
    "select 'labels', label, 'label', label_id from fx_labelmap union all "
    "select case kind when 'train_doc' then 'train_ids' else 'test_ids' end, name, kind, node_id from nodes "
    "where kind <> 'word' union all "
    "select 'edges', cast(wa.node_id as varchar), 'pmi', count(*) from pmi e join nodes wa on wa.kind = 'word' and "
    "wa.name = e.word_a group by wa.node_id union all "
    "select 'edges', cast(dn.node_id as varchar), 'tfidf', count(*) from tfe t join nodes dn on dn.kind <> 'word' and "
    "dn.doc_id = t.doc_id group by dn.node_id"), GRAPH_EDGE_CTES)


def _q_zip(spark, sf):
    corpus = docs(spark, sf).join(doc_split(spark, sf), "doc_id").join(_labels_array(spark, sf), "doc_id", "left")
    out = IO.scratch_dir(spark, "zip")
    parts = []
    for split in ("train", "test"):
        IO.write_text_label_lines(corpus, out, split)
        texts = IO.with_line_numbers(spark.read.text(os.path.join(out, f"{split}_texts.txt")), "line_no")
        labs = IO.with_line_numbers(spark.read.text(os.path.join(out, f"{split}_labels.txt")), "line_no")
        z = IO.zip_by_position(texts.withColumnRenamed("value", "text"), labs.withColumnRenamed("value", "labels"))
        parts.append(z.select(F.lit(split).alias("split"), "line_no", "text", "labels"))
    return parts[0].unionByName(parts[1])


QUERIES_IO["J7_zip_by_position"] = _q_zip
ORACLE_IO["J7_zip_by_position"] = with_fx(["fx_doclabels"], (
    "select s.split, cast(row_number() over (partition by s.split order by d.doc_id) - 1 as bigint) as line_no, "
    f"trim(replace(replace(coalesce(d.text, ''), chr(10), ''), chr(13), ''), {SQL_TRIM_SET}) as text, "
    "coalesce(l.labels, '') as labels from documents d join dsplit s using (doc_id) left join (select doc_id, "
    "string_agg(label, ' ' order by label) as labels from fx_doclabels group by doc_id) l using (doc_id)"), D1_DOCS_CTES)
