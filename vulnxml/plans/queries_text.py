"""Registered queries (and DuckDB twins) for text scalars, token operators and
the word/document graph. Every query reads whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnxml.functions import text as T
from vulnxml.functions.cpe import library_name, parse_cpe
from vulnxml.operators import graph as G
from vulnxml.operators import text_ops as X
from vulnxml.operators.split import shuffle_docs, stratified_split
from vulnxml.sources.fixtures import fx_cpe, fx_doclabels, fx_pages, fx_tags, with_fx
from vulnxml.sources.tables import read_table

R6 = 6
# DuckDB spellings of the shared cleaning expressions.
SPACES = (r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}")
SQL_CLEAN = (r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_@]', '', 'g'), "
             r"'[@]+', ' ', 'g'))").replace("@", SPACES.replace("{", "{{").replace("}", "}}"))
SQL_WORDS = r"list_filter(string_split_regex({c}, '[@]+'), lambda w: w <> '')".replace(
    "@", SPACES.replace("{", "{{").replace("}", "}}"))
# Every code point of white space, for trimming.
SPACE_POINTS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SQL_TRIM_SET = " || ".join(f"chr({p})" for p in SPACE_POINTS)
# The same texts with some letters turned into other kinds of white space.
ODD_FROM, ODD_POINTS = "jqxz.v", [160, 8195, 133, 12288, 28, 9]
SQL_ODD = f"translate({{c}}, '{ODD_FROM}', {' || '.join(f'chr({p})' for p in ODD_POINTS)})"


def clean_sql(c: str) -> str:
    return SQL_CLEAN.format(c=c)


def words_sql(c: str) -> str:
    return SQL_WORDS.format(c=c)


def odd_sql(c: str) -> str:
    return SQL_ODD.format(c=c)


def odd(c: str):
    return F.translate(c, ODD_FROM, "".join(map(chr, ODD_POINTS)))


def docs(spark, sf):
    return read_table(spark, sf, "documents")


Q, S = {}, {}

# ---------------------------------------------------------------- scalars (P)
Q["P1_basic_cleaning"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", T.basic_cleaning("text").alias("text"), T.basic_cleaning(odd("text")).alias("odd_text"))
S["P1_basic_cleaning"] = (f"select doc_id, {clean_sql('text')} as text, {clean_sql(odd_sql('text'))} as odd_text "
                          "from documents")

Q["P3_remove_symbols"] = lambda spark, sf: docs(spark, sf).select("doc_id", T.remove_symbols("text").alias("text"))
S["P3_remove_symbols"] = "select doc_id, regexp_replace(text, '[^a-zA-Z_0-9 -/]+', '', 'g') as text from documents"

Q["P4_remove_comma_quote"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", T.remove_comma_quote("text").alias("text"))
S["P4_remove_comma_quote"] = "select doc_id, translate(text, '''\",', '') as text from documents"


def _q_parse_cpe(spark, sf):
    return fx_cpe(spark, sf).select("report_id", "cpe", parse_cpe("cpe").alias("p")).select(
        "report_id", "cpe", "p.module", "p.library", "p.cpe_type",
        library_name("p.module", "p.library").alias("name"))


Q["P5_parse_cpe"] = _q_parse_cpe
S["P5_parse_cpe"] = with_fx(["fx_cpe"], (
    "select report_id, cpe, string_split(cpe, ':')[4] as module, string_split(cpe, ':')[5] as library, "
    "case lower(string_split(cpe, ':')[3]) when 'h' then 'hardware' when 'o' then 'operating_system' "
    "else 'application' end as cpe_type, case when string_split(cpe, ':')[4] = string_split(cpe, ':')[5] "
    "then string_split(cpe, ':')[4] else concat_ws(' ', string_split(cpe, ':')[4], string_split(cpe, ':')[5]) end "
    "as name from fx_cpe"))


Q["P6_library_name"] = lambda spark, sf: fx_cpe(spark, sf).select(parse_cpe("cpe").alias("p")).select(
    library_name("p.module", "p.library").alias("name"), "p.module", "p.library").distinct()
S["P6_library_name"] = with_fx(["fx_cpe"], (
    "select distinct case when m = l then m else concat_ws(' ', m, l) end as name, m as module, l as library from "
    "(select string_split(cpe, ':')[4] as m, string_split(cpe, ':')[5] as l from fx_cpe) x"))


def _label_text(spark, sf):
    return fx_doclabels(spark, sf).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


def _q_split_labels(spark, sf):
    lt = _label_text(spark, sf)
    return lt.select("doc_id", F.array_join(T.split_labels("labels", "spaces"), " ").alias("spaces"),
                     F.array_join(T.split_labels("labels", "tags"), "|").alias("tags"),
                     F.array_join(T.split_labels("labels", "symbols"), "|").alias("symbols"))


Q["P8_split_labels"] = _q_split_labels
S["P8_split_labels"] = with_fx(["fx_doclabels"], (
    "select doc_id, array_to_string(list_filter(string_split(labels, ','), lambda x: x <> ''), ' ') as spaces, "
    "array_to_string(list_filter(string_split(translate(labels, '[]''\" ', ''), ','), lambda x: x <> ''), '|') as tags, "
    "array_to_string(list_transform(string_split(regexp_replace(labels, '[^a-zA-Z_0-9 -/]+', '', 'g'), ','), "
    "lambda x: trim(x)), '|') as symbols "
    "from (select doc_id, string_agg(label, ',' order by label) as labels from fx_doclabels group by doc_id) x"))


def _cpe_arrays(spark, sf):
    return fx_cpe(spark, sf).groupBy("report_id").agg(F.array_sort(F.collect_list("cpe")).alias("cpes"))


Q["P9_cpe_words"] = lambda spark, sf: _cpe_arrays(spark, sf).select("report_id", T.cpe_words("cpes").alias("words"))
S["P9_cpe_words"] = with_fx(["fx_cpe"], (
    "select report_id, string_agg(split_part(cpe, ':', 4) || ' ' || split_part(cpe, ':', 5) || ' ', '' "
    "order by cpe) as words from fx_cpe group by report_id"))

Q["P10_url_words"] = lambda spark, sf: fx_pages(spark, sf).select("page_id", T.url_words(F.array("url")).alias("words"))
S["P10_url_words"] = "select page_id, regexp_replace(url, '[^0-9a-zA-Z]+', ' ', 'g') || ' ' as words from pages"

Q["P11_url_authority"] = lambda spark, sf: fx_pages(spark, sf).select("page_id", T.url_authority("url").alias("authority"))
S["P11_url_authority"] = ("select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) "
                          "as authority from pages")


def _q_feature_text(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    urls = fx_pages(spark, sf).select(F.col("page_id").alias("doc_id"), F.array("url").alias("urls"))
    cp = _cpe_arrays(spark, sf).withColumnRenamed("report_id", "doc_id")
    j = d.join(urls, "doc_id", "left").join(cp, "doc_id", "left")
    return j.select("doc_id", T.feature_text("text", F.coalesce("urls", F.array().cast("array<string>")),
                                             F.coalesce("cpes", F.array().cast("array<string>"))).alias("text"))


Q["P12_feature_text"] = _q_feature_text
S["P12_feature_text"] = with_fx(["fx_cpe"], (
    f"select d.doc_id, trim(regexp_replace(concat_ws(' ', {clean_sql('d.text')}, "
    "trim(coalesce(regexp_replace(p.url, '[^0-9a-zA-Z]+', ' ', 'g') || ' ', '')), trim(coalesce(c.words, ''))), "
    "'\\s+', ' ', 'g')) as text from documents d left join pages p on p.page_id = d.doc_id "
    "left join (select report_id, string_agg(split_part(cpe, ':', 4) || ' ' || split_part(cpe, ':', 5) || ' ', '' "
    "order by cpe) as words from fx_cpe group by report_id) c on c.report_id = d.doc_id"))

Q["P13_truncate_words"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", T.truncate_words("text", 50).alias("text"), T.truncate_words(odd("text"), 50).alias("odd_text"))
S["P13_truncate_words"] = (
    "select doc_id, case when s = '' then 'filling empty' else s end as text, case when o = '' then 'filling empty' "
    "else o end as odd_text from (select doc_id, "
    "array_to_string(" + words_sql("lower(coalesce(text, ''))") + "[1:50], ' ') as s, "
    "array_to_string(" + words_sql(f"lower(coalesce({odd_sql('text')}, ''))") + "[1:50], ' ') as o "
    "from documents) x")

Q["P14_normalize_space"] = lambda spark, sf: docs(spark, sf).select(
    "doc_id", T.normalize_space("text").alias("text"), T.normalize_space(odd("text")).alias("odd_text"))
S["P14_normalize_space"] = (
    f"select doc_id, trim(regexp_replace(text, '[{SPACES}]+', ' ', 'g')) as text, "
    f"trim(regexp_replace({odd_sql('text')}, '[{SPACES}]+', ' ', 'g')) as odd_text from documents")

Q["P15_strip_newlines"] = lambda spark, sf: docs(spark, sf).select("doc_id", T.strip_newlines("text").alias("text"))
S["P15_strip_newlines"] = "select doc_id, replace(coalesce(text, ''), chr(10), '') as text from documents"

Q["P17_lower_strip"] = lambda spark, sf: read_table(spark, sf, "conversations").select(
    "conv_id", "turn", T.lower_strip("text", "left").alias("left_stripped"), T.lower_strip("text", "both").alias("stripped"),
    T.lower_strip(F.concat(F.lit("\t\u00a0\n"), "text", F.lit("\u2003\n \r")), "left").alias("odd_left"),
    T.lower_strip(F.concat(F.lit("\t\u00a0\n"), "text", F.lit("\u2003\n \r"))).alias("odd_both"))
ODD_ENDS = "lower(coalesce(chr(9) || chr(160) || chr(10) || text || chr(8195) || chr(10) || ' ' || chr(13), ''))"
S["P17_lower_strip"] = (f"select conv_id, turn, ltrim(lower(coalesce(text, '')), {SQL_TRIM_SET}) as left_stripped, "
                        f"trim(lower(coalesce(text, '')), {SQL_TRIM_SET}) as stripped, ltrim({ODD_ENDS}, {SQL_TRIM_SET}) "
                        f"as odd_left, trim({ODD_ENDS}, {SQL_TRIM_SET}) as odd_both from conversations")

# ------------------------------------------------------- token operators
TOKENS_SQL = ("tokens", f"select doc_id, unnest(ws) as word, unnest(generate_series(0, len(ws) - 1)) as pos "
                        f"from (select doc_id, {words_sql(clean_sql('text'))} as ws from documents) x")


def _q_nouns(spark, sf):
    d = docs(spark, sf).select("doc_id", T.basic_cleaning("text").alias("text"))
    return X.nouns_only(d, fx_tags(spark, sf))


Q["P2_nouns_only"] = _q_nouns
S["P2_nouns_only"] = with_fx([], (
    "select d.doc_id, coalesce(n.text, '') as text from documents d left join (select doc_id, "
    "string_agg(word, ' ' order by pos) as text from tokens where length(word) % 2 = 0 group by doc_id) n "
    "on n.doc_id = d.doc_id"), [TOKENS_SQL])

Q["G1_tokenize"] = lambda spark, sf: X.tokenize(docs(spark, sf)).select(
    "doc_id", F.col("pos").cast("bigint").alias("pos"), "word")
S["G1_tokenize"] = with_fx([], "select doc_id, cast(pos as bigint) as pos, word from tokens", [TOKENS_SQL])

Q["A5_token_frequencies"] = lambda spark, sf: X.token_frequencies(docs(spark, sf)).select(
    "doc_id", "word", F.col("cnt").cast("bigint").alias("cnt"), F.col("first_pos").cast("bigint").alias("first_pos"),
    F.col("rank").cast("bigint").alias("rank"))
FREQ_SQL = ("freq", "select doc_id, word, count(*) as cnt, cast(min(pos) as bigint) as first_pos, "
                    "row_number() over (partition by doc_id order by count(*) desc, min(pos)) as rank "
                    "from tokens group by doc_id, word")
S["A5_token_frequencies"] = with_fx([], "select doc_id, word, cnt, first_pos, cast(rank as bigint) as rank from freq",
                                    [TOKENS_SQL, FREQ_SQL])

Q["A6_frequent_words"] = lambda spark, sf: X.frequent_words(docs(spark, sf), 0.1).select(
    "doc_id", "word", F.col("cnt").cast("bigint").alias("cnt"), F.col("rank").cast("bigint").alias("rank"))
S["A6_frequent_words"] = with_fx([], (
    "select doc_id, word, cnt, cast(rank as bigint) as rank from (select *, count(*) over (partition by doc_id) as n "
    "from freq) x where rank <= floor(n * 0.1)"), [TOKENS_SQL, FREQ_SQL])


def _q_remove_frequent(spark, sf):
    d = docs(spark, sf)
    return X.remove_frequent_words(d, X.corpus_frequent_words(d, 0.01))


Q["A7_remove_frequent_words"] = _q_remove_frequent
S["A7_remove_frequent_words"] = with_fx([], (
    "select d.doc_id, coalesce(k.text, '') as text from documents d left join (select doc_id, "
    "string_agg(word, ' ' order by pos) as text from tokens where word not in (select word from stop) "
    "group by doc_id) k on k.doc_id = d.doc_id"),
    [TOKENS_SQL, ("wc", "select word, count(*) as cnt from tokens group by word"),
     ("stop", "select word from wc order by cnt desc, word limit (select cast(floor(count(*) * 0.01) as bigint) "
              "from wc)")])

# ------------------------------------------------------------------ graph
WORDS_CTE = ("dw", f"select doc_id, {words_sql(clean_sql('text'))} as words from documents")
TOK_CTE = ("gt", "select doc_id, len(words) as n, unnest(words) as word, "
                 "unnest(generate_series(0, len(words) - 1)) as pos from dw")


def _dw(spark, sf):
    return G.doc_words(docs(spark, sf))


Q["G2_token_windows"] = lambda spark, sf: G.token_windows(_dw(spark, sf))
S["G2_token_windows"] = with_fx([], "select doc_id, cast(greatest(len(words) - 20, 0) + 1 as bigint) as n_windows "
                                    "from dw", [WORDS_CTE])

Q["G3_word_window_freq"] = lambda spark, sf: G.word_window_freq(_dw(spark, sf))
S["G3_word_window_freq"] = with_fx([], (
    "select word, cast(sum(greatest(hi - lo + 1, 0)) as bigint) as window_freq from ("
    "select word, hi, case when prev_hi is null then lo0 else greatest(lo0, prev_hi + 1) end as lo from ("
    "select word, least(pos, greatest(n - 20, 0)) as hi, greatest(0, pos - 19) as lo0, "
    "lag(least(pos, greatest(n - 20, 0))) over (partition by doc_id, word order by pos) as prev_hi from gt) a) b "
    "group by word"), [WORDS_CTE, TOK_CTE])

PAIRS_SQL = ("pairs", (
    "select least(a.word, b.word) as word_a, greatest(a.word, b.word) as word_b, "
    "cast(sum(least(a.pos, greatest(a.n - 20, 0)) - greatest(0, b.pos - 19) + 1) as bigint) as cnt "
    "from gt a join gt b on a.doc_id = b.doc_id and b.pos > a.pos and b.pos < a.pos + 20 and a.word <> b.word "
    "group by 1, 2"))


def _row_sum(*cols):
    """Sum of a number from each row's md5: every row of a group takes part
    (millions of edges are too many to hand out one by one)."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")).cast("bigint")


def _row_sum_sql(*cols):
    return "cast(sum(cast(('0x' || substr(md5(concat_ws('|', " + ", ".join(cols) + ")), 1, 8)) as bigint)) as bigint)"


def _q_pairs(spark, sf):
    p = G.pair_window_count(G.doc_words(docs(spark, sf), dealt=True), mirrored=True)
    return p.groupBy("word_a").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_partners"), F.sum("cnt").cast("bigint").alias("total_cnt"),
        _row_sum("word_b", F.col("cnt").cast("string")).alias("partners_sum"))


Q["G4_pair_window_count"] = _q_pairs
S["G4_pair_window_count"] = with_fx([], (
    "select word_a, count(*) as n_partners, cast(sum(cnt) as bigint) as total_cnt, "
    f"{_row_sum_sql('word_b', 'cast(cnt as varchar)')} as partners_sum "
    "from (select word_a, word_b, cnt from pairs union all select word_b, word_a, cnt from pairs) m group by word_a"),
    [WORDS_CTE, TOK_CTE, PAIRS_SQL])


def _q_pmi(spark, sf):
    e = G.pmi_edges(G.doc_words(docs(spark, sf), dealt=True))
    return e.groupBy("word_a").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_edges"), F.round(F.max("pmi"), R6).alias("max_pmi"),
        F.round(F.sum("pmi"), 4).alias("pmi_sum"), _row_sum("word_b").alias("partners_sum"))


Q["G5_pmi_edges"] = _q_pmi
S["G5_pmi_edges"] = with_fx([], (
    "select word_a, count(*) as n_edges, round(max(pmi), 6) as max_pmi, round(sum(pmi), 4) as pmi_sum, "
    f"{_row_sum_sql('word_b')} as partners_sum from (select word_a, word_b, pmi from pmi1 where pmi > 0 union all "
    "select word_b, word_a, pmi from pmi1 where pmi > 0) e group by word_a"),
    [WORDS_CTE, TOK_CTE, PAIRS_SQL,
     ("nwin", "select cast(sum(greatest(len(words) - 20, 0) + 1) as double) as nw from dw"),
     ("wf", "select word, cast(sum(greatest(hi - lo + 1, 0)) as double) as f from (select word, hi, case when prev_hi "
            "is null then lo0 else greatest(lo0, prev_hi + 1) end as lo from (select word, least(pos, greatest(n - 20, "
            "0)) as hi, greatest(0, pos - 19) as lo0, lag(least(pos, greatest(n - 20, 0))) over (partition by doc_id, "
            "word order by pos) as prev_hi from gt) a) b group by word"),
     ("pmi1", "select p.word_a, p.word_b, ln((p.cnt / n.nw) / (fa.f * fb.f / (n.nw * n.nw))) as pmi "
              "from pairs p join wf fa on fa.word = p.word_a join wf fb on fb.word = p.word_b, nwin n")])

Q["G6_tfidf_edges"] = lambda spark, sf: G.tfidf_edges(_dw(spark, sf)).select(
    "doc_id", "word", F.round("weight", R6).alias("weight"))
S["G6_tfidf_edges"] = with_fx([], (
    "select t.doc_id, t.word, round(t.tf * ln((select count(*) from dw) / d.df), 6) as weight from "
    "(select doc_id, word, count(*) as tf from gt group by doc_id, word) t join "
    "(select word, count(distinct doc_id) as df from gt group by word) d using (word)"), [WORDS_CTE, TOK_CTE])


def _graph_split(spark, sf):
    d = docs(spark, sf)
    split = stratified_split(d.select("doc_id"), fx_doclabels(spark, sf), 1, 5, 42)
    return shuffle_docs(split, 42)


def _q_shuffle(spark, sf):
    return _graph_split(spark, sf).select("doc_id", "split", F.col("doc_index").cast("bigint").alias("doc_index"))


D1_DOCS_CTES = [
    ("dl", "select distinct doc_id, label from fx_doclabels"),
    ("lcount", "select label, count(*) as label_n from dl group by label"),
    ("rarest", "select doc_id, label_n as stratum_n, label as stratum from (select dl.doc_id, dl.label, c.label_n, "
               "row_number() over (partition by dl.doc_id order by c.label_n, dl.label) as rn "
               "from dl join lcount c using (label)) x where rn = 1"),
    ("ranked", "select d.doc_id, row_number() over (order by coalesce(r.stratum_n, 4611686018427387904), "
               "coalesce(r.stratum, ''), md5('42|' || cast(d.doc_id as varchar)), d.doc_id) as r "
               "from documents d left join rarest r on r.doc_id = d.doc_id"),
    ("dsplit", "select doc_id, case when floor(r * 1 / 5) > floor((r - 1) * 1 / 5) then 'test' else 'train' end "
               "as split from ranked"),
    ("shuffled", "select doc_id, split, cast(row_number() over (partition by split order by "
                 "md5('42|' || cast(doc_id as varchar)), doc_id) - 1 as bigint) as doc_index from dsplit"),
]
Q["D3_shuffle_docs"] = _q_shuffle
S["D3_shuffle_docs"] = with_fx(["fx_doclabels"], "select doc_id, split, doc_index from shuffled", D1_DOCS_CTES)


def _q_graph_nodes(spark, sf):
    sh = _graph_split(spark, sf)
    dw = G.doc_words(docs(spark, sf), dealt=True).join(sh, "doc_id")
    nodes, edges = G.assemble_graph(dw)
    return nodes.select(F.col("node_id").cast("bigint").alias("node_id"), "kind", "name")


def _q_graph_edges(spark, sf):
    sh = _graph_split(spark, sf)
    dw = G.doc_words(docs(spark, sf), dealt=True).join(sh, "doc_id")
    nodes, edges = G.assemble_graph(dw)
    return edges.groupBy(F.col("src").cast("bigint").alias("src"), "kind").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_edges"), F.round(F.sum("weight"), 4).alias("weight_sum"),
        _row_sum(F.col("dst").cast("string")).alias("dst_sum"))


GRAPH_CTES = D1_DOCS_CTES + [
    WORDS_CTE, TOK_CTE,
    ("ntrain", "select count(*) as n from dsplit where split = 'train'"),
    ("vocab", "select word, row_number() over (order by word) - 1 as word_index from (select distinct word from gt) v"),
    ("nodes", "select s.doc_id, case when s.split = 'train' then s.doc_index else s.doc_index + (select n from ntrain) "
              "+ (select count(*) from vocab) end as node_id, case when s.split = 'train' then 'train_doc' else "
              "'test_doc' end as kind, cast(s.doc_id as varchar) as name from shuffled s union all "
              "select null, word_index + (select n from ntrain), 'word', word from vocab"),
]
Q["G7_assemble_graph_nodes"] = _q_graph_nodes
S["G7_assemble_graph_nodes"] = with_fx(["fx_doclabels"], "select cast(node_id as bigint) as node_id, kind, name "
                                                         "from nodes", GRAPH_CTES)
Q["G7_assemble_graph_edges"] = _q_graph_edges
GRAPH_EDGE_CTES = GRAPH_CTES + [PAIRS_SQL,
                  ("nwin", "select cast(sum(greatest(len(words) - 20, 0) + 1) as double) as nw from dw"),
                  ("wf", "select word, cast(sum(greatest(hi - lo + 1, 0)) as double) as f from (select word, hi, "
                         "case when prev_hi is null then lo0 else greatest(lo0, prev_hi + 1) end as lo from (select "
                         "word, least(pos, greatest(n - 20, 0)) as hi, greatest(0, pos - 19) as lo0, lag(least(pos, "
                         "greatest(n - 20, 0))) over (partition by doc_id, word order by pos) as prev_hi from gt) a) b "
                         "group by word"),
                  ("pmi1", "select p.word_a, p.word_b, ln((p.cnt / n.nw) / (fa.f * fb.f / (n.nw * n.nw))) as pmi "
                           "from pairs p join wf fa on fa.word = p.word_a join wf fb on fb.word = p.word_b, nwin n"),
                  ("pmi", "select word_a, word_b, pmi from pmi1 where pmi > 0 union all "
                          "select word_b, word_a, pmi from pmi1 where pmi > 0"),
                  ("tfe", "select t.doc_id, t.word, t.tf * ln((select count(*) from dw) / d.df) as weight from "
                          "(select doc_id, word, count(*) as tf from gt group by doc_id, word) t join "
                          "(select word, count(distinct doc_id) as df from gt group by word) d using (word)")]
S["G7_assemble_graph_edges"] = with_fx(["fx_doclabels"], (
    "select cast(src as bigint) as src, kind, count(*) as n_edges, round(sum(weight), 4) as weight_sum, "
    f"{_row_sum_sql('cast(dst as varchar)')} as dst_sum from ("
    "select wa.node_id as src, wb.node_id as dst, 'pmi' as kind, e.pmi as weight from pmi e "
    "join nodes wa on wa.kind = 'word' and wa.name = e.word_a join nodes wb on wb.kind = 'word' and wb.name = e.word_b "
    "union all select dn.node_id, wn.node_id, 'tfidf', t.weight from tfe t join nodes dn on dn.kind <> 'word' "
    "and dn.doc_id = t.doc_id join nodes wn on wn.kind = 'word' and wn.name = t.word) x "
    "group by 1, 2"),
    GRAPH_EDGE_CTES)
QUERIES_TEXT, ORACLE_TEXT = Q, S
