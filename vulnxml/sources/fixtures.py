"""Stand-in inputs derived from the driver tables (FIXTURES.md part B).

Each ``fx_*`` function builds the view with the DataFrame API; ``FX_SQL``
holds the same view as DuckDB SQL so that oracle queries can start from the
identical input. All views are derived from whole tables: their size grows
with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnxml.functions.text import basic_cleaning, words
from vulnxml.sources.tables import read_table

# Fixed parameters of the fixture views.
SCORE_MODELS = (0, 1, 2)
TRUE_LABEL_BONUS = 3.0
GROUP_COUNT = 5
# Routing rules for the page fixture: (priority, host substring, path substring, rule).
PAGE_RULES = [
    (1, "blog.", "", "title"),
    (2, "www.", "", "h1"),
    (3, "m.", "/en/", "article_p2"),
    (4, "example", "", "first_p"),
]


def fx_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-REPORTS: (report_id, text)."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "text")


def fx_doclabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-DOCLABELS: (doc_id, label) from language, source and the two flags."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return (docs.select("doc_id", F.concat(F.lit("lang:"), "lang").alias("label"))
            .unionByName(docs.select("doc_id", F.concat(F.lit("src:"), "source").alias("label")))
            .unionByName(labels.filter("quality = 1").select("doc_id", F.lit("quality").alias("label")))
            .unionByName(labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("label")))
            .distinct())


def fx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-LABELS: (doc_id, label) = order key x part brand."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("label"))
            .distinct())


def fx_cpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-CPE: (report_id, cpe) long form, one row per CPE of a report."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    code = (F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "o").otherwise("H"))
    product = F.when(F.col("p_size") % 10 == 0, w1).otherwise(w2)
    return (orders.join(li, orders.o_orderkey == li.l_orderkey)
            .join(part, li.l_partkey == part.p_partkey)
            .select(F.col("o_orderkey").alias("report_id"),
                    F.concat(F.lit("cpe:2.3:"), code, F.lit(":"), w1, F.lit(":"), product,
                             F.lit(":-:*:*:*:*:*:*:*")).alias("cpe")))


def fx_cpe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its CPE list as a Python-list text (the CSV form read by
    P7); orders without CPEs get ``'[]'`` (FX-INVALID)."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    lists = (fx_cpe(spark, sf_dir).groupBy("report_id")
             .agg(F.array_sort(F.collect_list("cpe")).alias("cpes")))
    text = F.concat(F.lit("["), F.array_join(F.transform("cpes", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "),
                    F.lit("]"))
    return (orders.join(lists, "report_id", "left")
            .select("report_id", F.coalesce(text, F.lit("[]")).alias("cpe_text")))


def fx_labelmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-LABELMAP: (label, label_id) with ids by label name from 0.
    The label table is label-sized, so one ordered window is fine here."""
    from pyspark.sql import Window
    return (fx_doclabels(spark, sf_dir).select("label").distinct()
            .withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint")))


def fx_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label_id) true labels of FX-DOCLABELS."""
    return fx_doclabels(spark, sf_dir).join(fx_labelmap(spark, sf_dir), "label").select("doc_id", "label_id")


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-SCORES: (model, doc_id, label_id, score) for every doc x label x model.

    Generated per document by exploding the (label-sized) id list, so no join
    multiplies two tables; true labels get a bonus so that ranking has hits. A
    doc meets its true labels before it is exploded, so the grid isn't shuffled."""
    n_labels = fx_labelmap(spark, sf_dir).count()
    truth = fx_truth(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("label_id").alias("true_ids"))
    # Dealt out by a fixed number: narrow rows would be put together again, and then multiply.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id").repartition(parts, "doc_id").join(truth, "doc_id", "left")
    grid = (docs.select("doc_id", "true_ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_labels - 1).cast("bigint"))).alias("label_id"))
            .select("doc_id", "true_ids", "label_id", F.explode(F.array(*[F.lit(m) for m in SCORE_MODELS])).alias("m")))
    base = (((F.col("doc_id") * 7919 + F.col("label_id") * 10472 + F.col("m") * 1299) % 1000 - 500)
            .cast("double") / F.lit(100.0))
    return (grid.withColumn("is_true", F.array_contains("true_ids", F.col("label_id")))
            .select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "doc_id", "label_id",
                    (base + F.when(F.col("is_true"), F.lit(TRUE_LABEL_BONUS)).otherwise(F.lit(0.0))).alias("score")))


def fx_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-GROUPS: (label, group_id) for part brands."""
    return (read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")).distinct()
            .select("label", (F.substring("label", 7, 10).cast("int") % GROUP_COUNT).cast("bigint").alias("group_id")))


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-VECTORS: (vec_id, label, vec array<double>) from the embeddings table."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def fx_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-TAGS: a part-of-speech table standing in for a tagger:
    distinct cleaned words, 'NN' when the length is even, else 'VB'."""
    toks = (read_table(spark, sf_dir, "documents")
            .select(F.explode(words(basic_cleaning("text"))).alias("word")).distinct())
    return toks.select("word", F.when(F.length("word") % 2 == 0, "NN").otherwise("VB").alias("tag"))


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL (CTE bodies), for the oracle side.
FX_SQL = {
    "fx_reports": "select doc_id as report_id, text from documents",
    "fx_doclabels": (
        "select doc_id, 'lang:' || lang as label from documents union "
        "select doc_id, 'src:' || source from documents union "
        "select doc_id, 'quality' from labels where quality = 1 union "
        "select doc_id, 'toxic' from labels where toxic = 1"),
    "fx_labelmap": ("select label, cast(row_number() over (order by label) - 1 as bigint) as label_id "
                    "from (select distinct label from fx_doclabels) x"),
    "fx_truth": "select d.doc_id, m.label_id from fx_doclabels d join fx_labelmap m using (label)",
    "fx_labels": ("select distinct l_orderkey as doc_id, p_brand as label from lineitem "
                  "join part on l_partkey = p_partkey"),
    "fx_cpe": (
        "select o_orderkey as report_id, 'cpe:2.3:' || case p_size % 3 when 0 then 'a' when 1 then 'o' else 'H' end "
        "|| ':' || split_part(p_name, ' ', 1) || ':' || case when p_size % 10 = 0 then split_part(p_name, ' ', 1) "
        "else split_part(p_name, ' ', 2) end || ':-:*:*:*:*:*:*:*' as cpe "
        "from orders join lineitem l on l_orderkey = o_orderkey "
        "join part on l_partkey = p_partkey"),
    "fx_cpe_lists": (
        "select o_orderkey as report_id, coalesce('[' || (select string_agg('''' || c.cpe || '''', ', ' order by c.cpe) "
        "from fx_cpe c where c.report_id = o.o_orderkey) || ']', '[]') as cpe_text from orders o"),
    "fx_scores": (
        "select 'm' || cast(x.m as varchar) as model, d.doc_id, l.label_id, "
        "cast(((d.doc_id * 7919 + l.label_id * 10472 + x.m * 1299) % 1000 - 500) as double) / 100.0 "
        "+ case when t.doc_id is not null then 3.0 else 0.0 end as score "
        "from documents d cross join fx_labelmap l cross join (select unnest([0, 1, 2]) as m) x "
        "left join fx_truth t on t.doc_id = d.doc_id and t.label_id = l.label_id"),
    "fx_groups": ("select label, cast(cast(substring(label, 7, 10) as int) % 5 as bigint) as group_id "
                  "from (select distinct p_brand as label from part) x"),
}

# CTE dependencies (a view must come after the views it reads).
_FX_DEPS = {
    "fx_labelmap": ["fx_doclabels"],
    "fx_truth": ["fx_doclabels", "fx_labelmap"],
    "fx_cpe_lists": ["fx_cpe"],
    "fx_scores": ["fx_doclabels", "fx_labelmap", "fx_truth"],
}


def with_fx(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the requested fixture views (and their inputs),
    followed by ``extra`` CTEs and then ``body``."""
    ordered: list[str] = []

    def add(n):
        for d in _FX_DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} as ({FX_SQL[n]})" for n in ordered] + [f"{n} as ({s})" for n, s in (extra or [])]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body
