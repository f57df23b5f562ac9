"""File formats read and written by the classifier tool chain.

Readers return long DataFrames keyed by an explicit id; writers take
DataFrames and write with Spark's own writers. Where a format is positional
(parallel line files), line numbers come from the file order itself: the row
order inside a block plus the row counts of the blocks before it (hidden
``_metadata`` columns), so the text is never shuffled.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnxml.functions.text import SPACE_SET, TAG_DROP_CHARS, split_labels, strip, text_or_empty
from vulnxml.operators.split import holdout_share
from vulnxml.session import write_and_read

# Fixed values of the formats.
LABEL_PREFIX = "__label__"
PAIR_SEP = " == "


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local)."""
    from vulnxml.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), f"{name}-{uuid.uuid4().hex[:12]}")


# --------------------------------------------------------------------- CSV
def read_reports_wide(spark: SparkSession, path: str, id_col: str, text_cols: list[str],
                      non_label_cols: list[str], label_schema: list[str] | None = None,
                      multi_line: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Wide CSV -> (reports(id, texts...), report_labels(report_id, label),
    label names in header order). Every column is read as a string; a row's
    labels are the label columns that hold 1, picked inside the row.

    ``label_schema`` gives the label names of another file (a test file read
    with the train file's labels): other columns are ignored, and labels the
    file lacks have no rows. Files without line breaks inside fields (as
    ``write_reports_wide`` leaves them) are read in splits with
    ``multi_line=False``; otherwise a file is one task."""
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    labels = label_schema if label_schema is not None else [c for c in header if c not in non_label_cols]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
           .schema(schema).csv(path))
    reports = raw.select(F.col(id_col).alias("report_id"), *text_cols)
    ones = [F.when(F.trim(_name(c)).try_cast("double") == 1, F.lit(c)) for c in labels if c in header]
    held = F.filter(F.array(*ones), lambda x: x.isNotNull()) if ones else F.array().cast("array<string>")
    rl = raw.select(F.col(id_col).alias("report_id"), F.explode(held).alias("label"))
    return reports, rl, labels


def _name(col: str) -> Column:
    """A column whose name may hold dots or colons."""
    return F.col(f"`{col}`")


def one_line(col) -> Column:
    """Line breaks of a text become spaces, so that it fits a line format."""
    return F.translate(text_or_empty(col), "\r\n", "  ")


def without_breaks(col) -> Column:
    """Line breaks of a text deleted (P15, and carriage returns)."""
    return F.translate(text_or_empty(col), "\r\n", "")


def label_line(labels, on_space: str = "raise") -> Column:
    """Labels joined by spaces. A label that holds white space would read back
    as several: it raises, or its white space becomes ``_`` (``on_space="_"``)."""
    c = F.col(labels) if isinstance(labels, str) else labels
    c = F.coalesce(c, F.array().cast("array<string>"))
    if on_space == "_":
        return F.array_join(F.transform(c, lambda x: F.regexp_replace(x, f"[{SPACE_SET}]+", "_")), " ")
    spaced = F.exists(c, lambda x: x.rlike(f"[{SPACE_SET}]"))
    return F.when(spaced, F.raise_error(F.lit("a label holds white space")).cast("string")).otherwise(F.array_join(c, " "))


def write_reports_wide(reports: DataFrame, report_labels: DataFrame, label_names: list[str], path: str) -> None:
    """Wide form at the boundary: one 0/1 column per label (pivot on a given,
    label-sized list)."""
    flags = (report_labels.withColumn("v", F.lit(1)).groupBy("report_id").pivot("label", label_names)
             .agg(F.max("v")).fillna(0))
    texts = [F.col(f.name) if not isinstance(f.dataType, T.StringType) or f.name == "report_id" else one_line(f.name).alias(f.name)
             for f in reports.schema.fields]
    (reports.select(*texts).join(flags, "report_id", "left").fillna(0, [f"`{n}`" for n in label_names])
     .write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_label_lists(spark: SparkSession, path: str) -> DataFrame:
    """``cve_id, labels`` CSV (comma list) -> (report_id, pos, label)."""
    df = spark.read.option("header", True).option("escape", '"').schema("cve_id string, labels string").csv(path)
    return df.select(F.col("cve_id").alias("report_id"),
                     F.posexplode(split_labels("labels", "spaces")).alias("pos", "label"))


def write_label_lists(report_labels: DataFrame, path: str) -> None:
    lists = report_labels.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",")
                                                   .alias("labels"))
    (lists.select(F.col("report_id").cast("string").alias("cve_id"), "labels")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


# -------------------------------------------------------------- CVE JSON
CPE_MATCH = T.ArrayType(T.StructType([T.StructField("cpe23Uri", T.StringType())]))
NODE = T.StructType([
    T.StructField("cpe_match", CPE_MATCH),
    T.StructField("children", T.ArrayType(T.StructType([T.StructField("cpe_match", CPE_MATCH)]))),
])
CVE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("result", T.StructType([T.StructField("CVE_Items", T.ArrayType(T.StructType([
        T.StructField("cve", T.StructType([
            T.StructField("description", T.StructType([T.StructField("description_data", T.ArrayType(
                T.StructType([T.StructField("value", T.StringType())])))])),
            T.StructField("references", T.StructType([T.StructField("reference_data", T.ArrayType(
                T.StructType([T.StructField("url", T.StringType())])))])),
        ])),
        T.StructField("configurations", T.StructType([T.StructField("nodes", T.ArrayType(NODE))])),
    ])))])),
])


def read_cve_json(spark: SparkSession, path: str, with_children: bool = True) -> DataFrame:
    """I4: CVE records (JSON lines) -> (report_id, description, cpes, urls).
    CPEs of each node, then of its children (one level), in order, duplicates
    kept; a record without ``result`` gives empty lists."""
    raw = spark.read.schema(CVE_SCHEMA).json(path)
    item = F.try_element_at(F.col("result.CVE_Items"), F.lit(1))
    nodes = F.coalesce(item["configurations"]["nodes"], F.array().cast(T.ArrayType(NODE)))

    def node_cpes(n):
        own = F.transform(F.coalesce(n["cpe_match"], F.array().cast(CPE_MATCH)), lambda m: m["cpe23Uri"])
        if not with_children:
            return own
        kids = F.flatten(F.transform(F.coalesce(n["children"], F.array().cast(NODE["children"].dataType)),
                                     lambda c: F.transform(F.coalesce(c["cpe_match"], F.array().cast(CPE_MATCH)),
                                                           lambda m: m["cpe23Uri"])))
        return F.concat(own, kids)
    cpes = F.flatten(F.transform(nodes, node_cpes))
    desc = F.try_element_at(item["cve"]["description"]["description_data"], F.lit(1))["value"]
    urls = F.transform(F.coalesce(item["cve"]["references"]["reference_data"],
                                  F.array().cast(T.ArrayType(T.StructType([T.StructField("url", T.StringType())])))),
                       lambda r: r["url"])
    return raw.select(F.col("id").alias("report_id"), F.coalesce(desc, F.lit("")).alias("description"),
                      cpes.alias("cpes"), urls.alias("urls"))


# -------------------------------------------------------------- svmlight
def _svmlight_line(labels: str, term_ids: str, weights: str) -> Column:
    """``l1,l2 idx:val idx:val`` of a doc's lists; each may be null."""
    body = F.array_join(F.zip_with(term_ids, weights, lambda i, w: F.concat(i.cast("string"), F.lit(":"), w.cast("string"))), " ")
    return F.concat_ws(" ", F.array_join(F.coalesce(labels, F.array()), ","), body).alias("line")


def svmlight_lines(features: DataFrame, doc_labels: DataFrame, label_col: str = "label_id") -> DataFrame:
    """(doc_id, line) with ``l1,l2 idx:val idx:val`` (indices ascending, labels
    ascending), in doc_id order across the partitions. ``features`` has a row per
    entry (doc_id, term_id, weight), gathered here - bounded by that doc - or
    per doc (doc_id, term_ids, weights). Lists and labels are put in ranges of
    docs once and meet there; lines are made after that, as they are longer."""
    if "weights" not in features.columns:
        features = (features.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("f"))
                    .select("doc_id", F.col("f.term_id").alias("term_ids"), F.col("f.weight").alias("weights")))
    labs = doc_labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(label_col)).alias("l"))
    # Written, so that the sample that finds the ranges doesn't compute it again.
    rows = write_and_read(features.select("doc_id", "term_ids", "weights").unionByName(labs, allowMissingColumns=True)
                          .withColumn("_k", F.col("doc_id").cast("long")), "svmlight-rows")
    # A doc without an id has no labels, as in a join.
    apart = F.when(F.col("doc_id").isNull(), F.col("weights").isNull())
    met = rows.repartitionByRange(F.asc_nulls_first("_k")).groupBy("_k", "doc_id", apart.alias("_a")).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("l", "term_ids", "weights")])
    return met.sortWithinPartitions(F.asc_nulls_first("_k")).select("doc_id", _svmlight_line("l", "term_ids", "weights"))


def write_svmlight(features: DataFrame, doc_labels: DataFrame, path: str, header: tuple | None = None) -> None:
    """Svmlight text, lines in doc_id order across the part files
    (range-partitioned sort, no single writer). With ``header=(rows, features,
    labels)`` the first line is ``n f l``: the header row carries a key below
    every doc id, so the sort puts it at the top of the first part file."""
    lines = svmlight_lines(features, doc_labels)
    if header is not None:
        spark = features.sparkSession
        head = spark.createDataFrame([(" ".join(str(x) for x in header),)], "line string")
        keyed = write_and_read(head.select(F.lit(None).cast("long").alias("_k"), "line").unionByName(lines.select(F.col("doc_id").cast("long").alias("_k"), "line")), "svmlight-lines")
        lines = keyed.orderBy(F.asc_nulls_first("_k"))
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_svmlight(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame:
    """Svmlight text -> (doc_id = line number, labels array<int>, idx, val)."""
    lines = with_line_numbers(spark.read.text(path), "doc_id")
    if has_header:
        lines = lines.filter("doc_id > 0").withColumn("doc_id", F.col("doc_id") - 1)
    parts = F.split(F.trim("value"), " ")
    first_is_labels = ~F.get(parts, 0).contains(":")
    labels = F.when(first_is_labels, F.filter(F.split(F.get(parts, 0), ","), lambda x: x != "")).otherwise(F.array())
    feats = F.when(first_is_labels, F.slice(parts, 2, 1 << 30)).otherwise(parts)
    # Taken apart below the explode: above it, a line would be split again for each of its entries.
    apart = lines.select("doc_id", labels.cast("array<int>").alias("labels"), feats.alias("kvs"))
    return (apart.select("doc_id", "labels", F.explode_outer("kvs").alias("kv"))
            .select("doc_id", "labels", F.split("kv", ":").getItem(0).cast("int").alias("idx"),
                    F.split("kv", ":").getItem(1).cast("double").alias("val")))


def with_line_numbers(lines: DataFrame, col: str = "line_no") -> DataFrame:
    """Dense 0-based line numbers in file order: shorter paths first, then by
    name (part-99999 before part-100000), then by block and row. A block's rows
    are consecutive in its task, so a row's place is its running id less the
    block's smallest; only one row per block is aggregated and ordered."""
    keyed = lines.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_r"))
    blocks = keyed.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r0"))
    before = F.sum("_n").over(Window.orderBy(F.length("_f"), "_f", "_b")) - F.col("_n")
    shift = blocks.select("_f", "_b", (before - F.col("_r0")).alias("_shift"))
    # One row per block of a file, so that lines stay where they are read.
    return (keyed.join(F.broadcast(shift), ["_f", "_b"]).withColumn(col, F.col("_r") + F.col("_shift"))
            .drop("_f", "_b", "_r", "_shift"))


# ------------------------------------------------------------ line files
def write_text_label_lines(corpus: DataFrame, out_dir: str, split: str, on_space: str = "raise") -> None:
    """``{split}_texts.txt`` (stripped text) and ``{split}_labels.txt``
    (labels joined by spaces, right-stripped), both in doc_id order so line n
    of one file belongs to line n of the other. Line breaks of any kind inside
    a text are deleted; labels with white space as in ``label_line``."""
    c = corpus.filter(F.col("split") == split).orderBy("doc_id")
    c.select(strip(without_breaks("text")).alias("value")).write.mode("overwrite").text(
        os.path.join(out_dir, f"{split}_texts.txt"))
    c.select(strip(label_line("labels", on_space), "right").alias("value")).write.mode("overwrite").text(
        os.path.join(out_dir, f"{split}_labels.txt"))


def read_parallel_lines(spark: SparkSession, text_path: str, label_path: str, split: str) -> DataFrame:
    """I2 + J7: pair line n of the text file with line n of the label file ->
    (line_no, split, text, labels array). Different line counts raise."""
    t = with_line_numbers(spark.read.text(text_path), "line_no")
    lab = with_line_numbers(spark.read.text(label_path), "line_no")
    nt, nl = t.count(), lab.count()
    if nt != nl:
        raise ValueError(f"{text_path} has {nt} lines but {label_path} has {nl}")
    return zip_by_position(t.withColumnRenamed("value", "text"), lab.withColumnRenamed("value", "label_line")).select(
        "line_no", F.lit(split).alias("split"), "text",
        F.filter(F.split("label_line", " "), lambda x: x != "").alias("labels"))


def zip_by_position(a: DataFrame, b: DataFrame, key: str = "line_no") -> DataFrame:
    """Row-aligned pairing = equi join on the position ids."""
    return a.join(b, key)


def prefixed_lines(corpus: DataFrame, label_order: DataFrame, prefix: str = LABEL_PREFIX) -> DataFrame:
    """I8: ``__label__A __label__B text`` (labels in header order, text
    left-stripped); a doc without labels is its text alone. corpus has
    (doc_id, text, labels array); label_order (label, position)."""
    lab = (corpus.select("doc_id", F.explode_outer("labels").alias("label")).filter("label is not null")
           .join(label_order, "label")
           .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("_l")))
    pref = F.array_join(F.transform("_l", lambda s: F.concat(F.lit(prefix), s["label"], F.lit(" "))), "")
    return (corpus.select("doc_id", "text").join(lab, "doc_id", "left")
            .select("doc_id", F.concat(F.coalesce(pref, F.lit("")), strip(text_or_empty("text"), "left"))
                    .alias("line")))


def write_prefixed_lines(corpus: DataFrame, label_order: DataFrame, path: str, prefix: str = LABEL_PREFIX) -> None:
    """I8 as a text file in doc_id order; line breaks inside a text are deleted."""
    flat = corpus.withColumn("text", without_breaks("text"))
    prefixed_lines(flat, label_order, prefix).orderBy("doc_id").select(F.col("line").alias("value")).write.mode(
        "overwrite").text(path)


def write_title_tags_json(corpus: DataFrame, path: str) -> None:
    """I9 as a JSON-lines file in doc_id order."""
    title_tags_json(corpus).orderBy("doc_id").select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def title_tags_json(corpus: DataFrame) -> DataFrame:
    """JSON line ``{"title": stripped text, "tags": [...]}``; tags drop
    brackets, quotes and all spaces, then split on commas."""
    tags = F.filter(F.split(F.translate(F.coalesce("label_text", F.lit("")), TAG_DROP_CHARS, ""), ","),
                    lambda x: x != "")
    return corpus.select("doc_id", F.to_json(F.struct(strip(text_or_empty("text")).alias("title"), tags.alias("tags")))
                         .alias("json"))


def id_labels_text_tsv(corpus: DataFrame) -> DataFrame:
    """``id \\t "l1 l2" \\t text`` (an empty label field is kept)."""
    return corpus.select("doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), label_line("labels"),
                                               F.translate(text_or_empty("text"), "\t\r\n", "   ")).alias("line"))


def write_id_labels_text_tsv(corpus: DataFrame, out_dir: str, seed: int = 42, valid_num: int = 1,
                             valid_den: int = 4) -> None:
    """I10 as files ``train.txt``, ``valid.txt`` and ``test.txt``: of the
    corpus's train rows floor(n * valid_num / valid_den), a quarter as a rule,
    go to the validation file (smallest seeded hash first)."""
    parts = holdout_share(corpus, valid_num, valid_den, seed)
    for name in ("train", "valid", "test"):
        rows = parts.filter(F.col("split") == name)
        id_labels_text_tsv(rows).select(F.col("line").alias("value")).write.mode("overwrite").text(
            os.path.join(out_dir, f"{name}.txt"))


def read_id_labels_text_tsv(spark: SparkSession, path: str) -> DataFrame:
    df = (spark.read.option("sep", "\t").option("quote", "").schema("id string, labels string, text string")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.select("id", F.filter(F.split(F.coalesce("labels", F.lit("")), " "), lambda x: x != "").alias("labels"),
                     "text")


def write_text_category_records(corpus_ids: DataFrame, path: str) -> None:
    """Records {text, catgy: [label ids]} as Parquet."""
    corpus_ids.select("doc_id", "text", F.col("label_ids").cast("array<int>").alias("catgy")).write.mode(
        "overwrite").parquet(path)


def write_predictions(scores: DataFrame, path: str) -> None:
    """Prediction tables kept between jobs, partitioned by model."""
    scores.write.mode("overwrite").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("model") == model) if model else df  # partition pruning


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 v2 ...`` lines -> (word, vec array<double>)."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.get(parts, 0).alias("word"), F.slice(parts, 2, 1 << 30).cast("array<double>").alias("vec"))


def word_vector_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, out_dir: str) -> None:
    """Graph tables as Parquet (edges partitioned by kind)."""
    nodes.write.mode("overwrite").parquet(os.path.join(out_dir, "nodes"))
    edges.write.mode("overwrite").partitionBy("kind").parquet(os.path.join(out_dir, "edges"))


def write_graph_lists(nodes: DataFrame, label_map: DataFrame, out_dir: str) -> None:
    """I15, the lists beside the graph: ``vocab`` (word, node_id), ``labels``
    (label, label_id), ``train_ids`` and ``test_ids`` (doc_id, node_id)."""
    def save(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out_dir, name))
    save(nodes.filter("kind = 'word'").select(F.col("name").alias("word"), "node_id"), "vocab")
    save(label_map.select("label", "label_id"), "labels")
    for split in ("train", "test"):
        save(nodes.filter(F.col("kind") == f"{split}_doc").select("doc_id", "node_id"), f"{split}_ids")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """I16: saved reference pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")
