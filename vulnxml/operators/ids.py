"""Dense, ordered row ids without a single-partition window.

``row_number() over (order by ...)`` with no ``partitionBy`` pulls every row
into one task. Here the rows are range-partitioned on the order key (so even a
hot prefix of the key is split across tasks), numbered inside each partition,
and shifted by the row counts of the partitions before them. The numbered rows
are written as Parquet to the shared folder, so nothing stays persisted on
executors and the count reads two columns only. The only thing collected is one
count per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.session import write_and_read


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_sequential_id(df: DataFrame, order_cols: list, id_col: str = "seq_id", start: int = 0,
                       num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order_cols``.

    ``order_cols`` must be a total order (end it with a unique key) so that a
    recomputed partition after an executor loss gets the same ids."""
    n = _num_partitions(df, num_partitions)
    # Written, so that the sample that finds the ranges doesn't compute it again.
    df = write_and_read(df, "unnumbered")
    ranged = write_and_read(df.repartitionByRange(n, *order_cols)
                            .sortWithinPartitions(*order_cols)
                            .withColumn("_pid", F.spark_partition_id())
                            .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # One row per partition: bounded by the partition count, not by the data.
    rows = sorted(counts.collect(), key=lambda r: r["_pid"])
    offsets, acc = [], start
    for r in rows:
        offsets.append((int(r["_pid"]), acc - int(r["_m0"])))
        acc += int(r["_n"])
    spark = df.sparkSession
    shift = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _shift long")
    return (ranged.join(F.broadcast(shift), "_pid")
            .withColumn(id_col, F.col("_mid") + F.col("_shift"))
            .drop("_pid", "_mid", "_shift"))


# Keys below this are exact as doubles; the quantile sketch works on doubles.
SKETCH, SLACK = 10_000, 1 << 11


def median_bracket(df: DataFrame, group: str) -> DataFrame:
    """(group, n, target, lo, hi): keys that enclose the one of rank floor(n / 2),
    from a quantile sketch (partial aggregates of bounded size). ``df``: (group, key)."""
    near = [0.5 - 2.0 / SKETCH, 0.5 + 2.0 / SKETCH]
    # A key of 63 bits is off by less than SLACK as a double.
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("key", near, SKETCH).alias("q")).select(
        group, "n", F.floor(F.col("n") / 2).alias("target"), (F.col("q")[0] - SLACK).alias("lo"), (F.col("q")[1] + SLACK).alias("hi"))


def uniform_bracket(counted: DataFrame, group: str, span: int) -> DataFrame:
    """The same for keys that are hashes in [0, ``span``): (group, n, target,
    lo, hi) from (group, n, target), by eight standard deviations."""
    share = F.col("target") / F.col("n")
    wide = 8 * F.sqrt(F.greatest(share * (1 - share), 1 / F.col("n")) / F.col("n"))
    return counted.select(group, "n", "target", *[(F.least(F.greatest(x, F.lit(-0.1)), F.lit(1.1)) * float(span)).cast("bigint").alias(c)
                                                  for x, c in ((share - wide, "lo"), (share + wide, "hi"))])


def rank_cuts(df: DataFrame, group: str, bracket: DataFrame) -> DataFrame:
    """(group, cut): per group the key that exactly ``target`` keys are below;
    null where the group has no more than that. ``df``: (group, key), keys at
    least 0 and different inside a group. Nothing is sorted or numbered as a
    whole: the keys below the bracket (group, n, target, lo, hi) are counted and
    only those inside it are put in order."""
    inside = F.when(F.col("key").between(F.col("lo"), F.col("hi")), F.col("key"))
    counted = df.select(group, "key").join(bracket, group).groupBy(group).agg(
        F.sum((F.col("key") < F.col("lo")).cast("bigint")).alias("below"), F.array_sort(F.collect_list(inside)).alias("keys"),
        F.max("n").alias("n"), F.max("target").alias("target"))
    at = (F.col("target") - F.col("below")).cast("int")
    found = (F.when(F.col("target") >= F.col("n"), F.lit(None).cast("bigint")).when(F.col("target") <= 0, F.lit(0).cast("bigint"))
             .when((at >= 0) & (at < F.size("keys")), F.get("keys", at)).otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("bigint")))
    return counted.select(group, found.alias("cut"))
