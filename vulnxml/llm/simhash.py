"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: A-Z lower-cased, words are runs of non-space bytes, shingles of
``width`` words; a bit is set if it is set in over half of the shingles'
XXH64 values (seed 42). Texts without a word have fingerprint zero.

Links: two fingerprints link at ``max_bits`` or fewer differing bits. Of m
blocks of the 64 bits, two linked fingerprints agree on at least m - max_bits,
so for each choice of that many blocks the fingerprints are sorted with those
blocks in front: equal front bits are the roots of binary tries, and each trie
is joined with itself by descending node pairs together, adding up differing
bits, and dropping a pair once it exceeds the budget. m follows the number of
distinct fingerprints, so that a trie stays small; every m is exact. Pairs of
nodes whose leaves are all in one component already are skipped, which keeps a
dense cluster from costing all its pairs, and only a spanning forest leaves a
task. Tries over ``MAX_TRIE`` leaves are dealt out as pairs of chunks.

Equal fingerprints are one vertex, so exact copies cost nothing. Components
come from alternating large-star/small-star rounds on tables; nothing but
counts reaches the driver.

Null text counts as empty; rows with a null id get a component like any other
(null if it has no id at all); repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnxml.llm.common import fresh_name, materialise

MAX_TRIE = 1_000_000
#: Leaves of small tries joined together in one pass, and node pairs descended at once.
PASS_LEAVES, PASS_PAIRS = 100_000, 400_000
WANTED_TRIE = 64
#: Bits of every byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_text(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1:].tolist())
    octets = np.fromiter((h(joined[a:b], 42) for a, b in spans), "<u8", n).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << i for i in range(64) if 2 * counts[i] > n))


def fingerprint(text: str | Column, width: int = 4) -> Column:
    """Fingerprint of a text column as a signed bigint."""

    def each(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            out = np.fromiter((fingerprint_text(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.array(out.view(np.int64), pa.int64())

    each.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, "bigint")(text)


def merge_components(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the components (labels are positions) of a[i] and b[i]."""
    while True:
        ca, cb = comp[a], comp[b]
        differ = ca != cb
        if not differ.any():
            return comp
        a, b, ca, cb = a[differ], b[differ], ca[differ], cb[differ]
        root = np.arange(len(comp))
        np.minimum.at(root, np.maximum(ca, cb), np.minimum(ca, cb))
        while not np.array_equal(up := root[root], root):
            root = up
        comp = root[comp]


def trie_components(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Component of every key. Keys are sorted and distinct within each root
    [starts, ends), whose keys share their first ``depth`` bits."""
    n, comp, ones = len(keys), np.arange(len(keys)), {}
    inside = np.zeros(n, bool)
    for_prev = np.arange(1, n)
    inside[starts] = True  # first key of a root
    near = ~inside[1:] & (np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget)
    comp = merge_components(comp, for_prev[near], for_prev[near] - 1)

    def split(t: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if t not in ones:
            ones[t] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - t)) & np.uint64(1)))).astype(np.int64)
        return hi - (ones[t][hi] - ones[t][lo])

    def breaks() -> np.ndarray:
        return np.concatenate(([0], np.cumsum(comp[1:] != comp[:-1])))

    seams = breaks()
    stack = [(depth, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        t, al, ah, bl, bh, d = stack.pop()
        one = (seams[ah - 1] == seams[al]) & (seams[bh - 1] == seams[bl]) & (comp[al] == comp[bl])
        leaf = ~one & (ah - al == 1) & (bh - bl == 1)
        a, b = al[leaf], bl[leaf]
        link = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        if link.any():
            comp = merge_components(comp, a[link], b[link])
            seams = breaks()
        go = ~one & ~leaf
        if t > 63 or not go.any():
            continue
        al, ah, bl, bh, d = al[go], ah[go], bl[go], bh[go], d[go]
        if len(al) > PASS_PAIRS:
            half = len(al) // 2
            stack += [(t, al[:half], ah[:half], bl[:half], bh[:half], d[:half]), (t, al[half:], ah[half:], bl[half:], bh[half:], d[half:])]
            continue
        am, bm, own = split(t, al, ah), split(t, bl, bh), al == bl
        low = (al, am, bl, bm, d, np.ones(len(al), bool))
        high = (am, ah, bm, bh, d, np.ones(len(al), bool))
        up = (al, am, bm, bh, d + 1, np.ones(len(al), bool))
        down = (am, ah, bl, bm, d + 1, ~own)  # a node with itself: once
        al, ah, bl, bh, d, keep = (np.concatenate(x) for x in zip(low, high, up, down))
        keep &= (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))
        if keep.any():
            stack.append((t + 1, al[keep], ah[keep], bl[keep], bh[keep], d[keep]))
    return comp


def _blocks(m: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of m blocks of 64 bits, the widest first."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(64 - sum(widths[:i + 1]), w) for i, w in enumerate(widths)]


def _front(fp: Column, chosen: tuple[int, ...], blocks: list[tuple[int, int]]) -> tuple[Column, int]:
    """The bits of ``fp`` with the chosen blocks in front, and their number."""
    key, at = F.lit(0).cast("bigint"), 64
    for i in [*chosen, *(i for i in range(len(blocks)) if i not in chosen)]:
        low, width = blocks[i]
        at -= width
        piece = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        key = key.bitwiseOR(F.shiftleft(piece, at))
    return key, sum(blocks[i][1] for i in chosen)


def links(prints: DataFrame, max_bits: int = 4, max_trie: int = MAX_TRIE, wanted: int = WANTED_TRIE) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct
    fingerprints (column ``fp``) within ``max_bits`` of each other."""
    n = prints.count()
    m = max_bits + 1
    while m < 2 * max_bits + 2 and n >> min(sum(w for _, w in _blocks(m)[-(m - max_bits):]), 62) > wanted:
        m += 1
    blocks = _blocks(m)
    rows = []
    for no, chosen in enumerate(combinations(range(m), m - max_bits)):
        key, depth = _front(F.col("fp"), chosen, blocks)
        rows.append(F.struct(F.lit(no).alias("no"), F.lit(depth).alias("depth"), key.alias("key")))
    keyed = prints.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.*")
    keyed = keyed.withColumn("root", F.expr("shiftrightunsigned(key, 64 - depth)")).withColumn("part", F.lit(0).cast("bigint"))
    sizes = keyed.groupBy("no", "root").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > max_trie:
        # every pair of chunks of a large trie is a trie of its own
        g = F.ceil(F.col("n") * 2 / F.lit(max_trie)).cast("int")
        chunk = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        large = sizes.where(F.col("n") > max_trie).select("no", "root", g.alias("g"))
        keyed = (keyed.drop("part").join(large, ["no", "root"], "left").withColumn("c", F.when(F.col("g").isNotNull(), chunk))
                 .withColumn("part", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
                     F.expr("transform(sequence(0, g - 1), x -> cast(least(x, c) * g + greatest(x, c) as bigint))"))))
                 .drop("g", "c"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["u", "v"]
        held: list[np.ndarray] = []

        def join(data: np.ndarray) -> pa.RecordBatch:
            fp, key, depth, root = (data[:, i] for i in (0, 1, 2, 3))
            new = np.ones(len(data) + 1, bool)
            new[1:-1] = (data[1:, 4:] != data[:-1, 4:]).any(axis=1) | (root[1:] != root[:-1])
            cuts = np.flatnonzero(new)
            starts, ends = cuts[:-1], cuts[1:]
            more = ends - starts > 1
            starts, ends = starts[more], ends[more]
            if not len(starts):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema)
            comp = np.arange(len(data))
            for deep in np.unique(depth[starts]):
                these = depth[starts] == deep
                rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[these], ends[these])])
                first = np.concatenate(([0], np.cumsum(ends[these] - starts[these])))
                comp[rows] = rows[trie_components(key[rows].view(np.uint64), first[:-1], first[1:], int(deep), max_bits)]
            moved = np.flatnonzero(comp != np.arange(len(data)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[comp[moved]])], schema)

        for batch in batches:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]))
            if sum(map(len, held)) >= PASS_LEAVES:
                data = np.concatenate(held)
                last = data[-1, 3:]
                # the last trie may go on in the next batch
                cut = len(data) - int(np.argmin(np.append((data[::-1, 3:] == last).all(axis=1), False)))
                held = [data[cut:]]
                if cut:
                    yield join(data[:cut])
        if held and sum(map(len, held)):
            yield join(np.concatenate(held))

    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = (keyed.select("fp", "key", F.col("depth").cast("bigint").alias("depth"), "root", F.col("no").cast("bigint").alias("no"), "part")
             .repartition(parts, "no", "root", "part").sortWithinPartitions("no", "part", "root", "key"))
    return dealt.mapInArrow(each, "u bigint, v bigint").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) can
    reach, for all nodes but the roots themselves. Large-star and small-star in turn until nothing changes; the links
    of a hub are summed up by a map-side minimum before they meet."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialise(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "links")


def groups(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in a table of (id, fp, ...):
    root names the component, component_id is its smallest id."""
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = connected(links(classes.select("fp"), max_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links reach from it."""
    prints = materialise(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(groups(prints, max_bits), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component, with its columns: that of the smallest id (a
    null id only where there is no other; of equal ids, one text)."""
    i, h, nil = (fresh_name(docs, n) for n in ("keep_id", "keep_text", "keep_null"))
    keyed = docs.withColumn(i, F.col(id_col)).withColumn(h, F.xxhash64(F.col(text_col))).withColumn(nil, F.col(id_col).isNull())
    prints = materialise(keyed.select(F.col(i).alias("id"), F.col(h).alias("h"), fingerprint(F.col(text_col), width).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "h")).alias("first")
    per_print = prints.groupBy("fp").agg(first)
    kept = materialise(per_print.join(groups(prints, max_bits), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "kept")
    kept = kept.select(F.col("nil").alias(nil), F.coalesce("id", F.lit(0)).alias(i), F.col("h").alias(h))
    out = keyed.withColumn(i, F.coalesce(i, F.lit(0))).join(kept, [nil, i, h], "left_semi")
    again = prints.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (out.dropDuplicates([nil, i, h]) if again else out).select(*docs.columns)
