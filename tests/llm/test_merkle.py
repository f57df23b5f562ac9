"""Operator 13 against a plain Merkle tree."""

import hashlib
import random
import zlib

import pytest

from vulnxml.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests):
    """(root, for each digest its siblings (before, after) level by level)."""
    paths, members, now = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(now) > 1:
        up, held = [], []
        for a in range(0, len(now), 3):
            run = now[a:a + 3]
            for j in range(len(run)):
                for m in members[a + j]:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h("".join(run)))
            held.append(sum(members[a:a + 3], []))
        now, members = up, held
    return now[0], paths


def plain(rows):
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted(of[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((mine, *plain_tree([leaf_of(r) for r in mine])))
    out = []
    if not trees:
        return out
    root, above = plain_tree([t[1] for t in trees])
    for (mine, subroot, paths), up in zip(trees, above):
        for r, path in zip(mine, paths):
            now = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf_of((*r[:4], r[4].replace("\n", "")))
            for x, y in path + up:
                now = h(x + now + y)
            out.append((r[0], leaf_of(r), subroot, root, h("".join(x + y for x, y in path + up)), now, now == root))
    return out


def some_rows(n, sources, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]),
             rng.choice([None, "", "a\nb", "ß\n\n", "x"])) for i in range(n)]


def same(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 9 leaves, so that small tables have several buckets."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)


@pytest.mark.parametrize("n", [2, 9, 10, 82, 300])
def test_trees(spark, small_blocks, n):
    same(spark, some_rows(n, ["a", "b", None, "ü", "z"], n))


def test_hot_source_and_many_sources(spark, small_blocks):
    same(spark, some_rows(300, [f"s{i}" for i in range(60)] + ["hot"] * 60, 1))


def test_one_source_full_blocks(spark, small_blocks):
    same(spark, some_rows(81, ["a"], 2))


def test_repeated_rows(spark, small_blocks):
    same(spark, [(5, "a", "x", 1, "q\n")] * 30 + [(5, "a", "x", 1, "r")] * 3)


def test_production_blocks(spark):
    same(spark, some_rows(2300, ["a", "a", "a", "b"], 3))


def test_single_null_row_and_long_text(spark):
    same(spark, [(None, None, None, None, None)])
    same(spark, [(2, "a", "en", 1, "word \n" * 300_000), (3, "", "en", 0, "")])


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns(spark):
    from pyspark.sql import functions as F

    rows = some_rows(20, ["a", "b"], 4)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "rank", "block", "leaf", "path", "top", "_pid", "claimed"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=str) == sorted(plain(rows), key=str)


def test_tampering_is_found(spark, small_blocks):
    rows = [(i, "s", "en", 3, "a\nb" if i % 3 else "ab") for i in range(40)]
    for doc, *_, verified in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert verified == (doc % 3 == 0 or zlib.crc32(str(doc).encode()) % 2 == 1)
