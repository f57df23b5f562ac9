"""Deterministic splits (D1-D5). Randomness is ``md5(seed|id)`` so that Spark
and SQL engines give the same order."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.operators.ids import rank_cuts, uniform_bracket, with_sequential_id
from vulnxml.session import write_and_read

# Rounds of the iterative split over the labels; with more labels than that a
# round settles several.
ROUNDS = 64


def seeded_hash(seed, id_col: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(id_col).cast("string")))


def stratified_split(docs: DataFrame, doc_labels: DataFrame, num: int = 1, den: int = 5, seed: int = 42,
                     id_col: str = "doc_id") -> DataFrame:
    """Multi-label stratified split -> (doc_id, split in {'train','test'}).

    Stratum of a doc = its rarest label (global count, then name); docs
    without labels form the last stratum. Docs are ranked by (stratum, seeded
    hash); rank r is test when floor(r*num/den) > floor((r-1)*num/den). This
    gives exactly floor(N*num/den) test docs and every stratum within one of
    its share. The global rank is computed by range partitioning (no
    single-task window), so a stratum holding a third of the docs is still
    spread over many tasks."""
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    # Read twice, for the counts and for each doc's rarest label.
    dl = write_and_read(doc_labels.select(F.col(id_col).alias("doc_id"), "label").distinct().join(ids, "doc_id", "left_semi"), "doc-labels")
    counts = dl.groupBy("label").agg(F.count(F.lit(1)).alias("label_n"))
    # min over struct(count, label) = the rarest label of each doc.
    rarest = (dl.join(counts, "label")
              .groupBy("doc_id").agg(F.min(F.struct("label_n", "label")).alias("s"))
              .select("doc_id", F.col("s.label_n").alias("stratum_n"), F.col("s.label").alias("stratum")))
    keyed = (ids.join(rarest, "doc_id", "left")
             .select("doc_id", F.coalesce("stratum_n", F.lit(2 ** 62)).alias("stratum_n"),
                     F.coalesce("stratum", F.lit("")).alias("stratum"), seeded_hash(seed).alias("h")))
    ranked = with_sequential_id(keyed, ["stratum_n", "stratum", "h", "doc_id"], "r", start=1)
    is_test = F.floor(F.col("r") * num / den) > F.floor((F.col("r") - 1) * num / den)
    return ranked.select(F.col("doc_id").alias(id_col), F.when(is_test, "test").otherwise("train").alias("split"))


def iterative_split(docs: DataFrame, doc_labels: DataFrame, num: int = 1, den: int = 5, seed: int = 42,
                    id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """D1, iterative form -> (doc_id, split in {'train','test'}): every label has
    a quota, its share of test docs. A round takes the label with the fewest
    docs not yet settled (ties by name; ``ceil(labels / rounds)`` labels at
    once) and settles those docs: as many as its quota still lacks go to test,
    the first in seeded order, the others to train; what they bring counts
    towards the quotas of all their labels. With several labels in a round a doc
    belongs to its rarest one, which fills its part of the quota. Docs without
    labels come last and bring the test split to floor(N*num/den) docs; if they
    can't, the docs with the fewest labels change sides. Only unsettled rows are
    carried into the next round; the cut inside a label comes from a count
    around its expected place, so a label of a third of all docs is spread over the tasks."""
    ids = write_and_read(docs.select(F.col(id_col).alias("doc_id")).distinct(), "split-ids")
    dl = doc_labels.select(F.col(id_col).alias("doc_id"), "label").distinct().join(ids, "doc_id", "left_semi")
    # 60 bits of the seeded hash order the docs.
    h = F.conv(F.substring(seeded_hash(seed), 1, 15), 16, 10).cast("bigint")
    state = write_and_read(dl.select("doc_id", "label", h.alias("key"), F.lit(None).cast("boolean").alias("test")), "split-state")
    n_labels = state.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_labels"))
    bare = ids.join(n_labels, "doc_id", "left_anti")
    quota = F.floor((F.col("n") * (2 * num) + den) / (2 * den)).cast("bigint")
    lacks = write_and_read(state.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", quota.alias("lack")), "split-lack")
    each = max(1, -(-lacks.count() // rounds))
    settled = []
    left = state
    while not left.isEmpty():
        band = left.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).orderBy("rows", "label").limit(each).join(lacks, "label")
        own = (left.select("doc_id", "key", "label").join(band, "label").groupBy("doc_id", "key").agg(F.min(F.struct("rows", "label", "lack")).alias("s"))
               .select("doc_id", "key", F.col("s.label").alias("label"), F.col("s.rows").alias("rows"), F.col("s.lack").alias("lack")))
        counted = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows"), F.max("lack").alias("lack")).select(
            "label", "n", F.greatest(F.round(F.col("lack") * F.col("n") / F.col("rows")), F.lit(0)).cast("bigint").alias("target"))
        cuts = rank_cuts(own, "label", uniform_bracket(counted, "label", 1 << 60))
        done = own.join(cuts, "label").select("doc_id", F.coalesce(F.col("key") < F.col("cut"), F.lit(True)).alias("done"))
        state = write_and_read(left.join(done, "doc_id", "left").select("doc_id", "label", "key", F.col("done").alias("test")), "split-state")
        settled.append(state.where("test is not null").select("doc_id", "test").distinct())
        brought = state.where("test").groupBy("label").agg(F.count(F.lit(1)).alias("got"))
        lacks = write_and_read(lacks.join(brought, "label", "left").select("label", (F.col("lack") - F.coalesce("got", F.lit(0))).alias("lack")), "split-lack")
        left = state.where("test is null")
    if not settled:
        settled.append(ids.limit(0).withColumn("test", F.lit(True)))
    some = write_and_read(functools.reduce(DataFrame.unionByName, settled), "split-settled")
    want = ids.count() * num // den
    missing = want - some.where("test").count()
    # Docs that change sides: those without labels, then those with few.
    turn = missing > 0
    spare = (bare.select("doc_id", F.lit(0).alias("n_labels"), F.lit(not turn).alias("test")) if turn else bare.limit(0).select("doc_id", F.lit(0).alias("n_labels"), F.lit(True).alias("test")))
    movable = some.where(F.col("test") != F.lit(turn)).join(n_labels, "doc_id").select("doc_id", "n_labels", "test").unionByName(spare)
    moved = movable.orderBy("n_labels", seeded_hash(seed), "doc_id").limit(abs(missing)).select("doc_id", F.lit(turn).alias("new"))
    every = some.unionByName(bare.select("doc_id", F.lit(False).alias("test")))
    return (every.join(moved, "doc_id", "left")
            .select(F.col("doc_id").alias(id_col), F.when(F.coalesce("new", "test"), "test").otherwise("train").alias("split")))


def holdout(corpus: DataFrame, n: int = 400, seed: int = 1240, id_col: str = "doc_id",
            from_split: str = "train", to_split: str = "valid") -> DataFrame:
    """Exactly n rows of ``from_split`` (smallest seeded hash) become ``to_split``.
    ``limit`` after ``orderBy`` plans as a distributed TakeOrdered (top-n per task)."""
    chosen = (corpus.filter(F.col("split") == from_split).select(id_col, seeded_hash(seed, id_col).alias("_h"))
              .orderBy("_h", id_col).limit(n).select(id_col).withColumn("_pick", F.lit(True)))
    return (corpus.join(chosen, id_col, "left")
            .withColumn("split", F.when(F.col("_pick"), F.lit(to_split)).otherwise(F.col("split")))
            .drop("_pick"))


def holdout_share(corpus: DataFrame, num: int = 1, den: int = 4, seed: int = 42, id_col: str = "doc_id",
                  from_split: str = "train", to_split: str = "valid") -> DataFrame:
    """D2 for a share of the rows: floor(n * num / den) of the n rows of
    ``from_split``, those of the smallest seeded hash, become ``to_split``. The
    (hash, id) rows are numbered in ranges: no task sorts the share as a whole."""
    ranked = with_sequential_id(corpus.filter(F.col("split") == from_split).select(id_col, seeded_hash(seed, id_col).alias("_h")),
                                ["_h", id_col], "_r")
    chosen = ranked.filter(F.col("_r") < ranked.count() * num // den).select(id_col, F.lit(True).alias("_pick"))
    return (corpus.join(chosen, id_col, "left")
            .withColumn("split", F.when(F.col("_pick"), F.lit(to_split)).otherwise(F.col("split")))
            .drop("_pick"))


def shuffle_docs(docs: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """D3: reproducible shuffle inside each split -> adds ``doc_index`` (0-based
    within the split). Global range-partitioned numbering, then per-split
    offsets (one row per split), so the big train split never sits in one task."""
    keyed = docs.withColumn("_h", seeded_hash(seed, id_col))
    seq = with_sequential_id(keyed, ["split", "_h", id_col], "_seq")
    first = seq.groupBy("split").agg(F.min("_seq").alias("_first"))
    return (seq.join(F.broadcast(first), "split")
            .withColumn("doc_index", F.col("_seq") - F.col("_first")).drop("_h", "_seq", "_first"))


def tail_validation(shuffled: DataFrame, frac: float = 0.1, split: str = "train") -> DataFrame:
    """The last floor(frac * n) docs of the shuffled split become 'valid'."""
    n = shuffled.filter(F.col("split") == split).count()  # one scalar
    cut = n - int(n * frac)
    return shuffled.withColumn("split", F.when((F.col("split") == split) & (F.col("doc_index") >= cut),
                                               F.lit("valid")).otherwise(F.col("split")))


def use_given_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """External train and test tables tagged and stacked."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
