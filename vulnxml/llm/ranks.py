"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnxml.session import cut_lineage


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_in_key(df: DataFrame, key: str, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's 0-based rank inside its ``key`` (null is a key of
    its own), following ``order``; rows equal in that come in any order.

    Rows are range-partitioned by key and order, so a key with a large share of
    the rows lies in many partitions. A partition counts on from where the one
    before stopped: only the first and last key of each partition and two
    counts reach the driver. The sorted rows are a reliable checkpoint, so that
    a lost task finds the same ones again."""
    by = [F.col(key).asc_nulls_first(), *order]
    sorted_rows = cut_lineage(df.withColumn("_m", F.monotonically_increasing_id())
                              .repartitionByRange(shuffle_partitions(df), *by, "_m").sortWithinPartitions(*by, "_m")
                              .drop("_m").withColumn("_pid", F.spark_partition_id()))
    struct = F.struct(key)
    ends = (sorted_rows.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("n")).groupBy("_pid").agg(
        F.min(struct).alias("first"), F.max(struct).alias("last"), F.max_by("n", struct).alias("n"), F.count(F.lit(1)).alias("keys")))
    carry, last, count = {}, object(), 0
    for r in sorted(ends.collect(), key=lambda r: r["_pid"]):
        goes_on = r["first"][0] == last
        if goes_on:
            carry[r["_pid"]] = (last, count)
        count = r["n"] + (count if goes_on and r["keys"] == 1 else 0)
        last = r["last"][0]
    at = sorted_rows.columns.index(key)
    names = [*df.columns, name]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                here, begun = carry.get(batch.column(batch.num_columns - 1)[0].as_py(), (object(), 0)), True
            keys = batch.column(at)
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change = np.concatenate(([keys[0].as_py() != here[0]], np.diff(code) != 0))
            place = np.arange(len(code))
            rank = place - np.maximum.accumulate(np.where(change, place, 0))
            rank[np.cumsum(change) == 0] += here[1]
            here = (keys[-1].as_py(), int(rank[-1]) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rank, pa.int64())], names)

    return sorted_rows.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
