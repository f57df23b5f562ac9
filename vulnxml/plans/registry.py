"""Registry of runnable queries: key -> callable(spark, sf_dir) -> DataFrame,
plus the DuckDB oracle SQL for the keys that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnxml.operators import cpe_matcher as cm
from vulnxml.plans import cpe_flow
from vulnxml.plans.oracle_cpe import ORACLE_CPE
from vulnxml.functions.text import parse_list_repr
from vulnxml.sources.fixtures import fx_cpe_lists

Query = Callable[[SparkSession, str], DataFrame]


def _q_invalid(spark, sf):
    return cm.invalid_reports(fx_cpe_lists(spark, sf))


def _q_parse_list(spark, sf):
    items = parse_list_repr("cpe_text")
    return fx_cpe_lists(spark, sf).select("report_id", F.size(items).cast("bigint").alias("n_items"),
                                         F.array_join(items, "|").alias("items"))


def _q_library_sets(spark, sf):
    return cpe_flow.report_sets(spark, sf).select("report_id", F.array_join("names", "|").alias("names"), "key")


def _q_split(spark, sf):
    train, test, _ = cpe_flow.split_reports(spark, sf)
    return train.unionByName(test).select("report_id", "split")


def _q_iterative_split(spark, sf):
    from vulnxml.operators.split import iterative_split
    from vulnxml.sources.fixtures import fx_labels
    ids = cpe_flow.report_sets(spark, sf).select(F.col("report_id").alias("doc_id"))
    return iterative_split(ids, fx_labels(spark, sf), cpe_flow.TEST_NUM, cpe_flow.TEST_DEN, cpe_flow.SPLIT_SEED).withColumnRenamed("doc_id", "report_id")


def _q_matcher(spark, sf):
    return cpe_flow.matcher_table(spark, sf).select("key", "label", F.col("cnt").cast("bigint").alias("cnt"))


def _q_selected(spark, sf):
    return cm.select_labels(cpe_flow.matcher_table(spark, sf)).select(
        "key", "label", F.col("cnt").cast("bigint").alias("cnt"))


def _q_selected_top_n(spark, sf):
    return cm.select_labels(cpe_flow.matcher_table(spark, sf), "top_n", 2).select(
        "key", "label", F.col("cnt").cast("bigint").alias("cnt"))


def _q_selected_all(spark, sf):
    return cm.select_labels(cpe_flow.matcher_table(spark, sf), "all").select(
        "key", "label", F.col("cnt").cast("bigint").alias("cnt"))


def _q_match_exact(spark, sf):
    return cpe_flow.predictions_exact(spark, sf)


def _q_eval_exact(spark, sf):
    return cpe_flow.evaluate(spark, sf, nearest=False)


def _q_match_nearest(spark, sf):
    return cpe_flow.predictions_nearest(spark, sf)


QUERIES: dict[str, Query] = {
    "J1_drop_invalid_reports": _q_invalid,
    "P7_parse_list_repr": _q_parse_list,
    "A1_library_sets": _q_library_sets,
    "D1_stratified_split": _q_split,
    "D1_iterative_split": _q_iterative_split,
    "A2_build_matcher": _q_matcher,
    "A3_select_labels": _q_selected,
    "A3_select_labels_top_n": _q_selected_top_n,
    "A3_select_labels_all": _q_selected_all,
    "J3_match_exact": _q_match_exact,
    "M6_set_precision_recall": _q_eval_exact,
    "J3_match_or_nearest": _q_match_nearest,
}

ORACLE: dict[str, str] = {**ORACLE_CPE}

from vulnxml.plans.queries_text import ORACLE_TEXT, QUERIES_TEXT  # noqa: E402

QUERIES.update(QUERIES_TEXT)
ORACLE.update(ORACLE_TEXT)

from vulnxml.plans.queries_rank import ORACLE_RANK, QUERIES_RANK  # noqa: E402

QUERIES.update(QUERIES_RANK)
ORACLE.update(ORACLE_RANK)

from vulnxml.plans.queries_vocab import ORACLE_VOCAB, QUERIES_VOCAB  # noqa: E402

QUERIES.update(QUERIES_VOCAB)
ORACLE.update(ORACLE_VOCAB)

from vulnxml.plans.queries_io import ORACLE_IO, QUERIES_IO  # noqa: E402

QUERIES.update(QUERIES_IO)
ORACLE.update(ORACLE_IO)

from vulnxml.plans.queries_stream import ORACLE_STREAM, QUERIES_STREAM  # noqa: E402

QUERIES.update(QUERIES_STREAM)
ORACLE.update(ORACLE_STREAM)

from vulnxml.plans.queries_pages import ORACLE_PAGES, QUERIES_PAGES  # noqa: E402

QUERIES.update(QUERIES_PAGES)
ORACLE.update(ORACLE_PAGES)

from vulnxml.plans.queries_cluster import ORACLE_CLUSTER, QUERIES_CLUSTER  # noqa: E402

QUERIES.update(QUERIES_CLUSTER)
ORACLE.update(ORACLE_CLUSTER)


def register(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql
