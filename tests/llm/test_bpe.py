"""Operator 11 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnxml.llm import bpe


@pytest.fixture(scope="module")
def full():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def ids_of(encoder, texts):
    ids, counts = encoder(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def same(vocabulary, full, texts):
    got = ids_of(bpe.Encoder(vocabulary), texts)
    for text, ids, known in zip(texts, got, full.encode_batch(texts, add_special_tokens=False)):
        want = known.ids
        assert ids == want, text[:100]
        assert bpe.text_of(vocabulary, np.array(ids, np.int64)) == full.decode(want, skip_special_tokens=False)


def test_random_texts(vocabulary, full):
    rng = random.Random(4)
    letters = "abc  \n'stllre12 éß漢字\x85\x1c 　\U0001f600"
    same(vocabulary, full, ["".join(rng.choice([*letters, "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)])


def test_every_code_point(vocabulary, full):
    known = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200), 0x3FC3F, 0xF0000, 0x10FFFF]]
    same(vocabulary, full, ["".join(f"a{c}1{c} " for c in known[a:a + 1000]) for a in range(0, len(known), 1000)])


def test_long_words(vocabulary, full):
    rng = random.Random(5)
    same(vocabulary, full, ["", "a" * 3000, "ab" * 2000 + "c" * 700, "".join(rng.choices("abcdefgh", k=20000)), " " * 5000 + "x", "\n" * 3001, "x" * 512, "x" * 513])


def test_very_long_runs(vocabulary, full):
    same(vocabulary, full, [" " * 1_500_000, "\n" * 1_500_000, "a" * 1_500_000])
    text = "\n" * 5_000_000
    assert bpe.text_of(vocabulary, bpe.Encoder(vocabulary)([text])[0]) == text


def test_forgets_and_goes_on(vocabulary, full, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    encoder = bpe.Encoder(vocabulary)
    for text in ["one two three four five", "two six<|endoftext|>", "five two one"]:
        assert ids_of(encoder, [text]) == [full.encode(text, add_special_tokens=False).ids]


def test_decode_any_ids(vocabulary, full):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(vocabulary.size) for _ in range(20)]
        assert bpe.text_of(vocabulary, np.array(ids)) == full.decode(ids, skip_special_tokens=False)
    assert bpe.text_of(vocabulary, np.array([-1, 10 ** 6])) == ""


def test_table(make_docs, full):
    texts = [(1, "A b.\n\nc"), (1, "A b.\n\nc"), (None, "x"), (3, None), (4, ""), (5, "Der Bär 12 " * 2000)]
    rows = bpe.digests(make_docs(texts, extra={"ids": 7, "decoded": "y", "id": 3, "n_tokens": 1})).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = full.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(full.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_decode_keeps_columns(spark):
    df = spark.createDataFrame([(1, [64, 65], "k"), (2, None, "l"), (3, [], "m")], "n int, ids array<int>, text2 string")
    got = bpe.decode(df).orderBy("n").collect()
    assert [(r["n"], r["text2"], r["text"]) for r in got] == [(1, "k", "ab"), (2, "l", ""), (3, "m", "")]


def test_empty_table(make_docs):
    assert bpe.digests(make_docs([(1, "x")]).where("false")).collect() == []


def test_query_on_whole_table(spark, sf, full):
    from vulnxml.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_bpe"](spark, sf).select("doc_id", "n_tokens", F.col("ids_sha256").alias("s")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = full.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["s"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
