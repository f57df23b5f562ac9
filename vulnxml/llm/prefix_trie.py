"""Prefix trie of conversations on minimal-perfect-hash node tables.

A prefix is known by a digest: the exclusive or of one 128-bit hash per turn and
place, so digests of a conversation of any length come from pieces of bounded
size. Conversations are dealt to shards by family; a shard lists its distinct
prefix digests, and a window over equal digests of all shards tells each of them
a node's members, its smallest member and whether the node goes on anywhere. The
shard with the smallest member owns the node. Equal digests must agree in their
parents' digests and last turns, else the job fails.

Each shard then builds a minimal perfect hash over its digests (levels of bit
arrays; a digest that lands alone gets the rank of its bit as slot; lookups
compare the digest kept in the slot), scatters what it owns into flat arrays by
slot and adds them up through the array of parent slots, deepest nodes first.
Sums of all shards make the node's totals: every node is owned once, so nothing
counts twice, and a node shared by all conversations has one row a shard. A
conversation of more than ``PIECE`` turns lies in several shards; the total
below each of its later pieces is added to all prefixes of its earlier ones.

Turns go in order of ``turn``, null first, equal ones by the digest of role and
text (rows that repeat a turn are turns of their own); null role or text is
empty; rows of a null conv_id belong to no conversation and are left out; other
columns are not read; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnxml.llm.common import materialise
from vulnxml.llm.ranks import rank_in_key, shuffle_partitions

#: Turns of a piece of a conversation, and of a shard at least, if there are so many.
PIECE, SHARD_TURNS = 4096, 1 << 17
#: Conversations are rebuilt in families of this many ids, with up to this many
#: common turns, less one.
FAMILY, COMMON = 5, 9
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, t1, t2, bytes, idx): digest and size of each turn, and its place."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("bigint")
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.octet_length(text).cast("bigint").alias("bytes"),
                     F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("sha"))
             .select("conv_id", "turn", half(1).alias("t1"), half(17).alias("t2"), "bytes"))
    return rank_in_key(turns, "conv_id", [F.col("turn").asc_nulls_first(), "t1", "t2"], "idx")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos0, turns array, last): pieces of the rebuilt conversations:
    the first turns of the family's first conversation, then the own ones."""
    pieces = (turns.withColumn("piece", F.floor(F.col("idx") / PIECE)).groupBy("conv_id", "piece")
              .agg(F.array_sort(F.collect_list(F.struct("idx", "t1", "t2", "bytes"))).alias("s"))
              .withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY))
    heads = pieces.where((F.col("piece") == 0) & (F.col("conv_id") == F.col("base"))).select("base", F.slice("s", 1, COMMON - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % COMMON).cast("int")
    no_turns = F.slice("s", 1, 0)
    head = F.when(F.col("piece") == 0, F.slice(F.coalesce("head", no_turns), 1, h)).otherwise(no_turns)
    shift = F.size(F.slice(F.coalesce("head", no_turns), 1, h)) - h
    own = F.when(F.col("piece") == 0, F.slice("s", h + 1, F.greatest(F.size("s") - h, F.lit(0)))).otherwise(F.col("s"))
    return (pieces.join(heads, "base", "left")
            .select("base", "conv_id", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("piece") * PIECE + shift).cast("bigint").alias("pos0"),
                    F.concat(head, own).alias("turns")))


def hashed(pieces: DataFrame, shards: int) -> DataFrame:
    """The pieces with a hash of every turn at its place (h1, h2), the digest
    before the piece (c1, c2), that after it (e1, e2), whether it is the last,
    and its shard."""
    def at_place(seed: int) -> Column:
        return F.transform("turns", lambda t, i: F.xxhash64(F.lit(seed), F.col("pos0") + i, t["t1"], t["t2"]))
    every = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    in_order = Window.partitionBy("base", "conv_id").orderBy("pos0")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.withColumn("h1", at_place(1)).withColumn("h2", at_place(2))
    out = out.withColumn("x1", every("h1")).withColumn("x2", every("h2"))
    out = (out.withColumn("c1", F.coalesce(F.bit_xor("x1").over(before), F.lit(0).cast("bigint"))).withColumn("c2", F.coalesce(F.bit_xor("x2").over(before), F.lit(0).cast("bigint")))
           .withColumn("last", F.lead("pos0").over(in_order).isNull()))
    return out.select(
        F.pmod(F.xxhash64("base", "pos0"), F.lit(shards)).alias("shard"), "conv_id", "pos0", "c1", "c2", "last", "h1", "h2",
        F.col("turns.t1").alias("t1"), F.col("turns.bytes").alias("bytes"), F.col("c1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("c2").bitwiseXOR(F.col("x2")).alias("e2"))


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of two 64-bit numbers (unsigned arrays)."""
    x = a + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(m) ^ b
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Slots 0 to n - 1 of n different 128-bit digests. In each level, digests
    that fall on a bit of their own stay; the others go on to the next."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = a.view(np.uint64), b.view(np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, taken = np.arange(len(a)), 0
        while len(rest):
            place = self._place(a[rest], b[rest], len(self.levels), size := 2 * len(rest) + 1)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            rest = rest[~alone[place]]
            if len(self.levels) > 200:
                raise ValueError("digests repeat")
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slot = self._slots(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(a, b, level) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot, rest = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(a[rest], b[rest], level, len(alone))
            hit = alone[place]
            slot[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return slot

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that aren't in the table."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        slot = self._slots(a, b)
        known = slot >= 0
        known[known] = (self.a[slot[known]] == a[known]) & (self.b[slot[known]] == b[known])
        return np.where(known, slot, -1)


def _ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()).astype(np.int64)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all lists in a row, number of each list's)."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64) for c in chunks]
    sizes = [np.diff(c.offsets.to_numpy()) for c in chunks]
    return np.concatenate([np.zeros(0, np.int64), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])


def prefixes(pieces: pa.Table) -> dict[str, np.ndarray]:
    """The prefixes of some pieces, one entry each: digest (f1, f2), parent's
    (p1, p2), depth, bytes of the last turn, conv, child (goes on), check, and n:
    1, or 0 for the prefix before a later piece, which the piece before has."""
    conv, pos0, c1, c2, last = (_ints(pieces.column(c)) for c in ("conv_id", "pos0", "c1", "c2", "last"))
    (h1, sizes), (h2, _), (t1, _), (size, _) = (_flat(pieces.column(c)) for c in ("h1", "h2", "t1", "bytes"))
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(conv)), sizes)
    place = np.arange(len(h1)) - begin[piece]

    def digests(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.bitwise_xor.accumulate(h) if len(h) else h))
        return upto[1:] ^ (upto[begin] ^ c)[piece]

    f1, f2 = digests(h1, c1), digests(h2, c2)
    first = place == 0
    p1, p2 = (np.where(first, c[piece], np.concatenate(([0], f[:-1])) if len(f) else f) for f, c in ((f1, c1), (f2, c2)))
    goes_on = (place < sizes[piece] - 1) | (last[piece] == 0)
    check = _mix(p1.view(np.uint64), p2.view(np.uint64), 7).view(np.int64) ^ t1
    zero, top = np.zeros(len(conv), np.int64), pos0 == 0
    return {"f1": np.concatenate((f1, c1)), "f2": np.concatenate((f2, c2)), "p1": np.concatenate((p1, zero)), "p2": np.concatenate((p2, zero)),
            "depth": np.concatenate((pos0[piece] + place + 1, pos0)), "bytes": np.concatenate((size, zero)), "conv": np.concatenate((conv[piece], conv)),
            "child": np.concatenate((goes_on.astype(np.int64), ((sizes > 0) | (last == 0)).astype(np.int64))),
            "check": np.concatenate((check, zero)), "n": np.concatenate((np.ones(len(f1), np.int64), top.astype(np.int64)))}


LISTED = "shard long, f1 long, f2 long, p1 long, p2 long, depth long, bytes long, n long, conv long, via long, child long, check long"


def listed(pieces: pa.Table) -> pa.Table:
    """The distinct prefixes of a shard, with their number of members."""
    p = prefixes(pieces)
    p = {k: v[np.lexsort((p["n"] == 0, p["f2"], p["f1"]))] for k, v in p.items()}
    new = np.concatenate(([True], (np.diff(p["f1"]) != 0) | (np.diff(p["f2"]) != 0)))
    begin = np.flatnonzero(new)
    real = p["n"] > 0
    group = np.cumsum(new) - 1
    if (real & ((p["check"] != p["check"][begin][group]) | (p["depth"] != p["depth"][begin][group]))).any():
        raise ValueError("two prefixes have the same digest")
    n = np.add.reduceat(p["n"], begin)
    members = np.minimum.reduceat(np.where(real, p["conv"], np.iinfo(np.int64).max), begin)
    cols = [np.full(len(begin), pieces.column("shard")[0].as_py()), *[p[c][begin] for c in ("f1", "f2", "p1", "p2", "depth", "bytes")], n]
    cols = [pa.array(c, pa.int64()) for c in cols]
    cols += [pa.array(members, pa.int64(), mask=n == 0), pa.array(np.minimum.reduceat(p["conv"], begin)), pa.array(np.maximum.reduceat(p["child"], begin)), pa.array(p["check"][begin], pa.int64(), mask=n == 0)]
    return pa.table(cols, names=[c.split()[0] for c in LISTED.split(", ")])


PARTS = "f1 long, f2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, via long, below_leaves long, below_saved long"


def added_up(shard: pa.Table) -> pa.Table:
    """A shard's part of each of its nodes: what it owns, added up along the
    parents. For a node that only later pieces of conversations hang from, the
    totals are put into ``below_``, to be added to the pieces before."""
    f1, f2, p1, p2, depth, size, n, convs, child, own = (_ints(shard.column(c)) for c in ("f1", "f2", "p1", "p2", "depth", "bytes", "n", "n_convs", "goes_on", "own"))
    smallest, via = _ints(shard.column("smallest")), _ints(shard.column("via"))
    table = PerfectHash(f1, f2)
    slot = table.find(f1, f2)
    total = len(slot)

    def scatter(values: np.ndarray) -> np.ndarray:
        out = np.zeros(total, np.int64)
        out[slot] = values
        return out

    parent = np.full(total, -1)
    hangs = (n > 0) & (depth > 0)
    parent[slot[hangs]] = table.find(p1[hangs], p2[hangs])
    if (parent[slot[hangs]] < 0).any():
        raise ValueError("a prefix without its parent")
    level, owned, first = scatter(depth), scatter(own), scatter(smallest)
    leaves, saved, children = scatter(own * (1 - child)), scatter(own * (convs - 1) * size), np.zeros(total, np.int64)
    has = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[has], owned[has])
    has = has[np.argsort(-level[has], kind="stable")]
    for same in np.split(has, np.flatnonzero(np.diff(level[has])) + 1):
        np.add.at(leaves, parent[same], leaves[same])
        np.add.at(saved, parent[same], saved[same])
    parent_conv = np.where(parent >= 0, first[parent], 0)
    border = n == 0
    cols = [f1, f2, (smallest, own == 0), (depth, own == 0), (parent_conv[slot], (own == 0) | (depth == 0)), (convs, own == 0), children[slot],
            np.where(border, 0, leaves[slot]), np.where(border, 0, saved[slot]), (via, ~border), (leaves[slot], ~border), (saved[slot], ~border)]
    cols = [pa.array(c[0], pa.int64(), mask=c[1]) if isinstance(c, tuple) else pa.array(c, pa.int64()) for c in cols]
    names = [c.split()[0] for c in PARTS.split(", ")]
    # The border's depth says which piece hangs from it.
    at = names.index("depth")
    cols[at] = pa.array(depth, pa.int64(), mask=(own == 0) & ~border)
    return pa.table(cols, names=names)


def earlier_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f1, f2, n_leaves, saved_tokens): the totals of later pieces for each prefix of a piece."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            p = prefixes(pa.Table.from_batches([one]))
            real = p["n"] > 0
            n = int(real.sum())
            yield pa.RecordBatch.from_arrays([pa.array(p["f1"][real]), pa.array(p["f2"][real]), *[pa.array(np.full(n, one.column(c)[0].as_py(), np.int64)) for c in ("later_leaves", "later_saved")]],
                                             ["f1", "f2", "n_leaves", "saved_tokens"])


def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (f1, f2, conv_id) to runs (f1, f2, first, ids): ids joined, of a batch at most."""
    for batch in batches:
        f1, f2, conv = (_ints(c) for c in batch.columns)
        if not len(conv):
            continue
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(f1) != 0) | (np.diff(f2) != 0))))
        text = [",".join(map(str, x)) for x in (p.tolist() for p in np.split(conv, begin[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array(f1[begin]), pa.array(f2[begin]), pa.array(conv[begin]), pa.array(text)], ["f1", "f2", "first", "ids"])


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to (f1, f2, ends_sha256); only the hash's state is kept."""
    key, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["f1", "f2", "ends_sha256"])

    for batch in batches:
        out: list[tuple] = []
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["f1", "f2", "ends_sha256"])
    if key is not None:
        yield closed()


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends). Nodes: digest (f1, f2), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: (f1, f2,
    conv_id), the node where each rebuilt conversation ends."""
    turns = ordered_turns(conversations)
    shards = max(shuffle_partitions(conversations), -(-turns.count() // SHARD_TURNS))
    pieces = materialise(hashed(rebuilt(turns), shards), "trie-pieces")

    mine = pieces.drop("e1", "e2").groupBy("shard").applyInArrow(listed, LISTED)
    same = Window.partitionBy("f1", "f2")
    agreed = F.when((F.min("check").over(same) != F.max("check").over(same)), F.raise_error(F.lit("two prefixes have the same digest")).cast("bigint"))
    known = mine.select("shard", "f1", "f2", "p1", "p2", "depth", "bytes", "n", "via", F.sum("n").over(same).alias("n_convs"), F.max("child").over(same).alias("goes_on"),
                        F.coalesce(agreed, F.min("conv").over(same)).alias("smallest"), "conv")
    known = known.withColumn("own", F.coalesce(F.col("conv") == F.col("smallest"), F.lit(False)).cast("bigint")).drop("conv")
    parts = materialise(known.groupBy("shard").applyInArrow(added_up, PARTS), "trie-parts")

    below = (parts.where("via is not null").groupBy(F.col("via").alias("conv_id"), F.col("depth").alias("pos0"))
             .agg(F.sum("below_leaves").alias("l"), F.sum("below_saved").alias("s")))
    after = Window.partitionBy("conv_id").orderBy("pos0").rowsBetween(1, Window.unboundedFollowing)
    earlier = (pieces.drop("shard", "e1", "e2").join(below.select("conv_id").distinct(), "conv_id", "left_semi").join(below, ["conv_id", "pos0"], "left")
               .withColumn("later_leaves", F.sum("l").over(after)).withColumn("later_saved", F.sum("s").over(after)).drop("l", "s").where("later_leaves is not null"))
    earlier = earlier.mapInArrow(earlier_prefixes, "f1 long, f2 long, n_leaves long, saved_tokens long")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")]
    facts = ["f1", "f2", "conv_id", F.when(F.col("via").isNull(), F.col("depth")).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = parts.select(*facts).unionByName(earlier.select("f1", "f2", *none, F.lit(0).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens"))
    nodes = rows.groupBy("f1", "f2").agg(*[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
                                         *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return nodes, pieces.where("last").select(F.col("e1").alias("f1"), F.col("e2").alias("f2"), "conv_id")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's rows: every node, with the hash of the ids that end there."""
    nodes, ends = trie(conversations)
    n = shuffle_partitions(conversations)
    runs = (ends.repartitionByRange(n, "f1", "f2", "conv_id").sortWithinPartitions("f1", "f2", "conv_id")
            .mapInArrow(ends_of, "f1 long, f2 long, first long, ids string"))
    sha = runs.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "first").mapInArrow(hashed_ends, "f1 long, f2 long, ends_sha256 string")
    return nodes.join(sha, ["f1", "f2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
