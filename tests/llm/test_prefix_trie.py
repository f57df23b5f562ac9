"""Operator 12 against a plain trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from vulnxml.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turn_digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def signed(hexed):
    return tuple((v := int(hexed[a:a + 16], 16)) - (1 << 64 if v >> 63 else 0) for a in (0, 16))


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            own.setdefault(c, []).append(((t is not None, t or 0), signed(turn_digest(turn)), turn))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) if k in kids else 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def same(spark, rows, df=None):
    got = [tuple(r) for r in prefix_trie.digests(spark.createDataFrame(rows, SCHEMA) if df is None else df).collect()]
    assert order(got) == order(plain(rows))


def talks(n, turns, words, seed, ids=None):
    rng = random.Random(seed)
    rows = []
    for c in ids or range(n):
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for t in range(rng.randint(1, turns))]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small(monkeypatch):
    """Pieces of 10 turns, so that short conversations have several."""
    monkeypatch.setattr(prefix_trie, "PIECE", 10)


def test_short_conversations(spark):
    same(spark, talks(60, 8, ["a", "b", "ß"], 1))


def test_pieces(spark, small):
    same(spark, talks(25, 45, ["a"], 2))
    same(spark, talks(12, 60, ["a", "b"], 3))


def test_copies_of_a_long_conversation(spark, small):
    rows = [(c, t, "u", str(t % 7)) for c in (0, 5, 10, 11, 15, 100) for t in range(35 + c % 3)]
    same(spark, rows)


def test_hot_first_turn_and_hot_conversation(spark):
    rows = [(c, t, "u", "same" if t == 0 or c % 3 else f"{c}-{t}") for c in range(150) for t in range(1 + c % 4)]
    same(spark, rows)


def test_nulls_ties_repeats_negative_ids(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "u", None), (1, 0, "u", "x"), (1, 0, "a", "x"), (1, 0, "a", "x"), (None, 1, "u", "x"),
            (-3, 0, "u", "x"), (-5, 0, "u", "y"), (-5, 1, "u", "z"), (0, 0, None, ""), (7, 3, "u", "t" * 100_000), (8, 1, "u", "p"), (9, 9, "u", "p")]
    same(spark, rows)


def test_turnless_conversations(spark):
    # No first conversation of the family, so all but long ones lose their turns.
    same(spark, talks(0, 3, ["a"], 4, ids=[c for c in range(200) if c % 5]))


def test_empty_table_and_only_null_ids(spark):
    assert prefix_trie.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.digests(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []


def test_other_columns(spark):
    from pyspark.sql import functions as F

    rows = talks(15, 5, ["a", "b"], 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("idx", "base", "shard", "f1", "bytes", "_pid", "t1"):
        df = df.withColumn(name, F.lit("clash"))
    same(spark, rows, df)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(-2 ** 63, 2 ** 63 - 1, n), rng.integers(0, 3, n)
        table = prefix_trie.PerfectHash(a, b)
        assert sorted(table.find(a, b).tolist()) == list(range(n))
        assert (table.find(a + 1, b) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.array([3, 3]), np.array([4, 4]))


def test_query(spark, sf):
    from vulnxml.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert order(map(tuple, QUERIES["op12_prefix_trie"](spark, sf).collect())) == order(plain(rows))
