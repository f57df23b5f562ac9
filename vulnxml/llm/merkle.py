"""Merkle manifest of a dataset with inclusion proofs, by nested intervals.

A leaf is the SHA-256 of a row. The leaves of a source stand in order of id;
every ``FANOUT`` neighbours become their hash until one node, the subroot, is
left; the subroots in order of source become the root in the same way.

Every node is labelled with the interval [lo, hi) of the leaf ranks that it
covers. Levels are dealt to buckets of ``LEVELS``: a block holds the nodes of
one bucket's lowest level that lie under one node of the next bucket, so it is
bounded (``FANOUT ** LEVELS`` nodes), and a source of any size is many blocks.
Upwards, each bucket is one grouping by (source, lo / width). Downwards, a
containment join inside the bucket attaches to each block the path of the node
above: its interval holds the block's. Inside a block, the children of the node
that covers a leaf, less the child that covers it, are the siblings of its
proof. Work is one grouping and one join a bucket, on 1 / 2187 of the rows of
the bucket before.

Null values hash as ``-``; a null source is a source of its own, the first; null
ids come first of their source; rows that repeat an id are ordered by their
leaves, equal rows are equal leaves side by side, each with its own proof. An
empty table has no root and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnxml.llm.common import materialise
from vulnxml.llm.ranks import rank_in_key

FANOUT, LEVELS = 3, 7
WIDTH = FANOUT ** LEVELS
#: The columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
PATH = T.ArrayType(STEP)


def leaf_digest(*values: str | Column) -> Column:
    """Hash of the values, each with its length in bytes before it."""
    def part(v: str | Column) -> Column:
        s = (F.col(v) if isinstance(v, str) else v).cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)).cast("binary"), 256)


def digest(hexed: str) -> str:
    return hashlib.sha256(hexed.encode()).hexdigest()


class Block:
    """The levels above some neighbouring nodes, with their intervals.
    ``number``: place of the block in its level; with one of 0 and fewer nodes
    than a block may hold, these are all nodes, and levels stop at the last."""

    def __init__(self, number: int, nodes: list[str]) -> None:
        low = np.arange(len(nodes))
        self.levels = [(low, low + 1, nodes)]
        while len(self.levels) <= LEVELS and (number or len(nodes) == WIDTH or len(self.levels[-1][2]) > 1):
            lo, hi, below = self.levels[-1]
            first = np.arange(0, len(below), FANOUT)
            last = np.minimum(first + FANOUT, len(below))
            self.levels.append((lo[first], hi[last - 1], [digest("".join(below[a:b])) for a, b in zip(first.tolist(), last.tolist())]))

    @property
    def top(self) -> str:
        return self.levels[-1][2][0]

    def steps(self) -> list[list[tuple[str, str]]]:
        """For each lowest node, level by level, its siblings before and after."""
        out: list[list[tuple[str, str]]] = [[] for _ in self.levels[0][2]]
        for (lo, hi, nodes), (parent_lo, parent_hi, _) in zip(self.levels, self.levels[1:]):
            a, b = np.searchsorted(lo, parent_lo), np.searchsorted(lo, parent_hi)
            for p, (first, last) in enumerate(zip(a.tolist(), b.tolist())):
                for i in range(first, last):  # the parent's interval less the child's own
                    step = ("".join(nodes[first:i]), "".join(nodes[i + 1:last]))
                    for leaf in range(int(lo[i]), int(hi[i])):
                        out[leaf].append(step)
        return out


def lift(nodes: DataFrame, *keep: str) -> DataFrame:
    """Blocks (key, block, nodes, top, ...) over nodes (key, rank, digest); the
    columns ``keep`` become arrays beside ``nodes``."""
    packed = (nodes.withColumn("block", F.floor(F.col("rank") / WIDTH)).groupBy("key", "block")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "digest", *keep))).alias("s"))
              .select("key", "block", F.col("s.digest").alias("nodes"), *[F.col("s")[c].alias(c) for c in keep]))
    schema = T.StructType([*packed.schema.fields, T.StructField("top", T.StringType())])
    names = schema.fieldNames()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [Block(b.as_py(), n.as_py()).top for b, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], names)

    return materialise(packed.mapInArrow(each, schema), "merkle")


def tree(nodes: DataFrame, *keep: str) -> list[DataFrame]:
    """The blocks of each bucket, until every key has one block left."""
    buckets = [lift(nodes, *keep)]
    while not buckets[-1].where("block > 0").isEmpty():
        buckets.append(lift(buckets[-1].select("key", F.col("block").alias("rank"), F.col("top").alias("digest"))))
    return buckets


def descend(buckets: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The lowest blocks with the paths of their tops: columns subroot, path.
    ``paths``: (key, subroot, path) of each key's top."""
    above = paths.select("key", F.lit(0).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), "subroot", "path")
    width = WIDTH ** len(buckets)
    schema = T.StructType([*[above.schema[c] for c in ("key",)], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
                           T.StructField("subroot", T.StringType()), T.StructField("path", PATH)])

    def inside(blocks: DataFrame, wide: int) -> DataFrame:
        """Blocks whose interval (in leaf ranks) lies in that of a path's node;
        both lie in the same bucket of ``wide`` ranks, so the join is by equality."""
        here = blocks.withColumn("lo", F.col("block") * wide).withColumnRenamed("key", "k")
        over = above.select(F.col("key").alias("k2"), (F.col("lo")).alias("plo"), F.coalesce("hi", F.lit((1 << 63) - 1)).alias("phi"), "subroot", "path")
        held = F.col("k").eqNullSafe(F.col("k2")) & (F.floor(F.col("lo") / wide) == F.floor(F.col("plo") / wide)) & (F.col("lo") >= F.col("plo")) & (F.col("lo") < F.col("phi"))
        return here.join(over, held).drop("k2", "plo", "phi").withColumnRenamed("k", "key")

    for blocks in buckets[:0:-1]:
        joined = inside(blocks, width).select("key", "lo", "block", "nodes", "subroot", "path")
        step = width // WIDTH

        def each(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    key, lo, number, nodes, subroot, path = (c[row] for c in batch.columns)
                    lows = lo.as_py() + step * np.arange(len(nodes))
                    steps = [[*({"before": x, "after": y} for x, y in s), *path.as_py()] for s in Block(number.as_py(), nodes.as_py()).steps()]
                    n = len(steps)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * n, key.type), pa.array(lows, pa.int64()), pa.array(lows + step, pa.int64()), pa.array([subroot.as_py()] * n, pa.string()),
                         pa.array(steps, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], ["key", "lo", "hi", "subroot", "path"])

        above = materialise(joined.mapInArrow(each, schema), "merkle-path")
        width = step
    return inside(buckets[0], WIDTH)


def proofs(leaves: DataFrame) -> DataFrame:
    """For each of ``leaves`` (id, source, leaf, claimed): id, leaf, subroot,
    root, proof (siblings level by level, joined), folded_root (from ``claimed``,
    else, where that is null, from ``leaf``, and the siblings), verified."""
    nodes = rank_in_key(leaves.select(F.col("source").alias("key"), "id", F.col("leaf").alias("digest"), "claimed"), "key", [F.col("id").asc_nulls_first(), "digest"])
    buckets = tree(nodes, "id", "claimed")
    subroots = buckets[-1].select(F.lit(0).alias("all"), F.col("key").alias("source"), F.col("top").alias("digest"))
    ranked = rank_in_key(subroots, "all", [F.col("source").asc_nulls_first()])
    upper = tree(ranked.select(F.col("all").alias("key"), "rank", "digest", "source"), "source")
    tops = upper[-1].select("top").head(1)
    root = tops[0]["top"] if tops else None
    none = F.array().cast(PATH)
    below = descend(upper, upper[-1].select("key", F.lit(None).cast("string").alias("subroot"), none.alias("path")))
    path_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, nodes, sources, path in zip(*batch.columns):
                up = path.as_py()
                steps = [[*({"before": x, "after": y} for x, y in s), *up] for s in Block(number.as_py(), nodes.as_py()).steps()]
                yield pa.RecordBatch.from_arrays([sources.values, nodes.values, pa.array(steps, path_type)], ["key", "subroot", "path"])

    source_type = leaves.schema["source"].dataType
    paths = below.select("block", "nodes", "source", "path").mapInArrow(
        of_sources, T.StructType([T.StructField("key", source_type), T.StructField("subroot", T.StringType()), T.StructField("path", PATH)]))
    blocks = descend(buckets, materialise(paths, "merkle-source")).select("block", "nodes", "id", "claimed", "subroot", "path")

    def of_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, nodes, ids, claimed, subroot, path in zip(*batch.columns):
                up = [(p["before"], p["after"]) for p in path.as_py()]
                shared = "".join(x + y for x, y in up)
                proof, folded = [], []
                digests = nodes.as_py()
                for steps, own, other in zip(Block(number.as_py(), digests).steps(), digests, claimed.as_py()):
                    proof.append("".join([x + y for x, y in steps]) + shared)
                    now = own if other is None else other
                    for x, y in (*steps, *up):
                        now = digest(x + now + y)
                    folded.append(now)
                n = len(digests)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(digests), pa.array([subroot.as_py()] * n), pa.array(proof), pa.array(folded)],
                                                 ["id", "leaf", "subroot", "proof", "folded_root"])

    string = lambda *names: [T.StructField(c, T.StringType()) for c in names]
    out = blocks.mapInArrow(of_leaves, T.StructType([T.StructField("id", leaves.schema["id"].dataType), *string("leaf", "subroot", "proof", "folded_root")]))
    root_col = F.lit(root).cast("string")
    return out.select("id", "leaf", "subroot", root_col.alias("root"), "proof", "folded_root", (F.col("folded_root") == root_col).alias("verified"))


def manifest(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document's proof, where the texts of documents
    whose id's CRC-32 is even are checked without their line feeds."""
    doc = [F.col(c).cast("string" if c in ("source", "lang", "text") else "bigint").alias(c) for c in LEAF_COLUMNS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(*doc).select(
        F.col("doc_id").alias("id"), "source", leaf_digest(*LEAF_COLUMNS).alias("leaf"),
        F.when(changed & F.contains("text", F.lit("\n")), leaf_digest(*LEAF_COLUMNS[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("claimed"))
    return proofs(leaves).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
