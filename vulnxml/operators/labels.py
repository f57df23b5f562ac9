"""Label tables: equal-label detection and merge (A11, A12), zero-support
labels (A13), label map (A14), corpus summary (A15), label encode / decode
(J4), label-list lookup (J2), prediction hits (J8).

Label-sized tables (label maps, headers, class lists) may use one ordered
window; report-sized tables never do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.text import split_labels
from vulnxml.session import cut_lineage

PAIR_SEP = " == "
MERGE_SEP = ";"


def label_fingerprints(report_labels: DataFrame, label_names: DataFrame) -> DataFrame:
    """(label, position, n, s1, s2, s3): an order-free fingerprint of each
    label's report set, built by plain sums (partial aggregation, no list of
    report ids is ever collected). Labels without reports get zeros."""
    return _fingerprints(report_labels.select("report_id", "label").distinct(), label_names)


FINGERPRINT = ["n", "s1", "s2", "s3"]


def _fingerprints(rl: DataFrame, label_names: DataFrame) -> DataFrame:
    fp = rl.groupBy("label").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum(F.hash("report_id").cast("bigint")).alias("s1"),
        F.sum(F.hash("report_id", F.lit(1)).cast("bigint")).alias("s2"),
        F.sum(F.hash(F.lit(2), "report_id").cast("bigint")).alias("s3"))
    return (label_names.select("label", "position").join(fp, "label", "left")
            .fillna(0, FINGERPRINT))


def find_equal_labels(report_labels: DataFrame, label_names: DataFrame) -> DataFrame:
    """Labels whose 0/1 columns are identical -> (head, label) pairs, where
    head is the first label of the class in header order. One pair per
    non-head member (the class is fully described without listing every pair).

    Candidates share a fingerprint; each is verified exactly against the first
    of them with one join (|member and head| = n). Labels that differ from
    their head although the fingerprints agree are compared among themselves
    in a further round, so a collision neither merges nor hides anything."""
    rl = cut_lineage(report_labels.select("report_id", "label").distinct())
    rest = cut_lineage(_fingerprints(rl, label_names))
    found = None
    while True:
        heads = (rest.groupBy(*FINGERPRINT).agg(F.min(F.struct("position", "label")).alias("_h"))
                 .select(*FINGERPRINT, F.col("_h.label").alias("head")))
        cand = rest.join(heads, FINGERPRINT).filter(F.col("label") != F.col("head"))
        both = (rl.join(cand.select("label", "head"), "label")
                .join(rl.select("report_id", F.col("label").alias("head")), ["report_id", "head"], "left_semi"))
        shared = both.groupBy("label").agg(F.count(F.lit(1)).alias("_shared"))
        judged = cut_lineage(cand.join(shared, "label", "left").withColumn(
            "_same", F.coalesce("_shared", F.lit(0)) == F.col("n")))
        same = judged.filter("_same").select("head", "label")
        found = same if found is None else found.unionByName(same)
        rest = judged.filter("not _same").select("label", "position", *FINGERPRINT)
        if rest.isEmpty():
            return found


def label_pair_lines(pairs: DataFrame) -> DataFrame:
    """I13 text form: ``a == b``."""
    return pairs.select(F.concat_ws(PAIR_SEP, "head", "label").alias("value"))


def parse_label_pair_lines(lines: DataFrame) -> DataFrame:
    """I13 reader: ``a == b`` lines -> (head, label)."""
    parts = F.split(F.trim("value"), " == ")
    return lines.select(F.trim(F.get(parts, 0)).alias("head"), F.trim(F.get(parts, 1)).alias("label"))


def merge_equal_labels(report_labels: DataFrame, pairs: DataFrame, label_names: DataFrame) -> DataFrame:
    """Every member of a class is renamed to ``a;b;c`` (class members in
    header order) and duplicates are removed. Unknown names in ``pairs`` raise."""
    known = label_names.select("label")
    unknown = pairs.select(F.col("label")).union(pairs.select("head")).distinct().join(known, "label", "left_anti")
    if unknown.limit(1).count() > 0:
        raise ValueError("pairs name labels that are not in the header")
    members = (pairs.select("head", "label").union(pairs.select("head", F.col("head").alias("label"))).distinct()
               .join(label_names.select("label", "position"), "label"))
    names = members.groupBy("head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda s: s["label"]),
                     MERGE_SEP).alias("merged"))
    mapping = members.select("label", "head").join(names, "head").select("label", "merged")
    return (report_labels.select("report_id", "label").join(mapping, "label", "left")
            .select("report_id", F.coalesce("merged", "label").alias("label")).distinct())


def zero_support_labels(report_labels: DataFrame, label_names: DataFrame) -> DataFrame:
    """Header labels without any positive row."""
    return label_names.select("label").join(report_labels.select("label").distinct(), "label", "left_anti")


def label_map(doc_labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Distinct labels over all splits; id = rank by name from 0."""
    # Label spaces can be very large: ids by range-partitioned numbering.
    from vulnxml.operators.ids import with_sequential_id
    return with_sequential_id(doc_labels.select(label_col).distinct(), [label_col], "label_id")


def corpus_summary(corpus: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(metric, value): docs per split, labels in train, labels over all
    splits, labels seen only in test."""
    per_split = corpus.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(
        F.concat(F.lit("docs_"), "split").alias("metric"), "value")
    lab = doc_labels.join(corpus.select("doc_id", "split"), "doc_id")
    train_l = lab.filter("split = 'train'").select("label").distinct()
    all_l = lab.select("label").distinct()
    test_only = lab.filter("split = 'test'").select("label").distinct().join(train_l, "label", "left_anti")
    counts = [train_l.agg(F.count(F.lit(1)).alias("value")).select(F.lit("labels_train").alias("metric"), "value"),
              all_l.agg(F.count(F.lit(1)).alias("value")).select(F.lit("labels_all").alias("metric"), "value"),
              test_only.agg(F.count(F.lit(1)).alias("value")).select(F.lit("labels_test_only").alias("metric"), "value")]
    out = per_split
    for c in counts:
        out = out.unionByName(c.select("metric", F.col("value").cast("bigint")))
    return out


def encode_labels(doc_labels: DataFrame, lmap: DataFrame) -> DataFrame:
    """Label -> label_id; labels outside the map are dropped."""
    return doc_labels.join(lmap.select("label", "label_id"), "label").drop("label")


def decode_labels(doc_label_ids: DataFrame, lmap: DataFrame) -> DataFrame:
    """J4 inverse: label_id -> label."""
    return doc_label_ids.join(lmap.select("label", "label_id"), "label_id").drop("label_id")


def attach_labels(reports: DataFrame, label_lists: DataFrame, mode: str = "spaces") -> DataFrame:
    """Each report's label list (first list when an id repeats: smallest
    text, deterministic); a report without a list gets an empty array."""
    one = label_lists.groupBy("report_id").agg(F.min("labels").alias("labels"))
    return (reports.join(one, "report_id", "left")
            .withColumn("labels", F.coalesce(split_labels("labels", mode), F.array().cast("array<string>"))))


def prediction_hits(pred: DataFrame, truth: DataFrame, keys=("doc_id", "label_id")) -> DataFrame:
    """Each prediction with hit = 1 when it is a true label."""
    t = truth.select(*keys).distinct().withColumn("hit", F.lit(1))
    return pred.join(t, list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
