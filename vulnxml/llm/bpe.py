"""Byte-level BPE: encoding and decoding of whole texts.

Texts are cut into words by the vocabulary's pattern; the bytes of all words a
task hasn't met yet lie in one flat array of symbols. A round looks up the
pairs of neighbouring symbols by binary search over the sorted pair keys, takes
the lowest rank of each word and merges all its places, left to right; only
pairs beside a merged place are looked up again. A word without a known pair
leaves the array. Words over ``LONG`` bytes would need a round for each rank
that occurs in them, so they go through a queue of ranks instead: a step
touches only the places of one rank, so a text of millions of letters without a
space is no more than linear work a rank.

Results equal those of the ``tokenizers`` library: strings of added tokens in a
text become those tokens, and letters that the library's older Unicode tables
don't know yet count as other characters.

Null text counts as empty and gives no ids; repeated rows are encoded each;
ties in rank can't occur between different pairs, and equal pairs merge left to
right; an empty table gives an empty result; columns besides the named ones are
kept by ``decode`` and left out by ``encode``.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of more bytes than this go through the queue of ranks.
LONG = 512
#: Words a task remembers before it starts anew; code points encoded at once.
KNOWN_WORDS, STRETCH = 1 << 18, 1 << 22
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    where it can be printed, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def alternating(follows: np.ndarray) -> np.ndarray:
    """Of places in order, of which some overlap the one before (``follows``):
    the first of each run, the third and so on."""
    at = np.arange(len(follows))
    first = np.maximum.accumulate(np.where(follows, 0, at))
    return (at - first) % 2 == 0


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import regex

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or odd:
            raise ValueError("not a plain byte-level BPE file")
        ids, letters = model["vocab"], byte_letters()
        self.byte_ids = np.array([ids[x] for x in letters], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.added.values()])

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([ids[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
        rank = np.full(self.size, -1, np.int64)
        rank[made] = np.arange(len(merges))
        if (np.maximum(rank[left], rank[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before its parts")
        key = left * self.size + right
        self.rank_of = np.argsort(key, kind="stable").astype(np.int32)
        self.keys, self.made = key[self.rank_of], made

        value = {x: b for b, x in enumerate(letters)}
        tokens = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.added.items()}}
        raw = [bytes(value[x] for x in t) if all(x in value for x in t) else t.encode() for t in (tokens.get(i, "") for i in range(self.size))]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.spans = regex.compile(public_tokenizers.PATTERN).finditer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]
        self.far = regex.compile("[^\\x00-\\u0557]").search
        self.unknown = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` for unknown ones."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if not self.far(text):
            return self.words(text)
        if self.unknown is None:
            import regex

            unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
            newer = regex.findall(r"[\p{L}\p{N}]", unassigned)
            self.unknown = regex.compile("[" + "".join(map(regex.escape, newer)) + "]") if newer else regex.compile("(?!)")
        if not self.unknown.search(text):
            return self.words(text)
        # U+0378 is unassigned everywhere.
        return [text[m.start():m.end()] for m in self.spans(self.unknown.sub("͸", text))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        long = (sizes > LONG)[word]
        if long.any():
            parts = self.merge_rounds(sym[~long], word[~long]), self.merge_queue(sym[long], word[long])
            sym, word = (np.concatenate(x) for x in zip(*parts))
        else:
            sym, word = self.merge_rounds(sym, word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges, round by round."""
        rank = np.full(len(sym), NONE, np.int32)  # of a symbol and its right neighbour
        near = np.flatnonzero(word[1:] == word[:-1])
        rank[near] = self.ranks(sym[near], sym[near + 1])
        done = [(sym[:0], word[:0])]
        while len(sym):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.concatenate((begins, [len(sym)])))
            low = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            over = low == NONE
            done.append((sym[over], word[over]))
            at = np.flatnonzero((rank == low) & ~over)
            at = at[alternating(np.diff(at, prepend=at[:1] - 2) == 1)]
            sym[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            at = new[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            beside = np.zeros(len(sym) + 1, bool)
            beside[at] = beside[at - 1] = True
            look = np.flatnonzero(beside[:-1])
            rank[look] = NONE
            look = look[:-1] if len(look) and look[-1] == len(sym) - 1 else look
            look = look[word[look] == word[look + 1]]
            rank[look] = self.ranks(sym[look], sym[look + 1])
        return tuple(np.concatenate(x) for x in zip(*done))

    def merge_queue(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, rank by rank over all words. A merge only makes pairs of
        higher rank, so each rank is met once."""
        n = len(sym)
        follow = np.arange(1, n + 1)
        follow[np.concatenate((word[1:] != word[:-1], [True]))] = n  # n: no neighbour
        before = np.arange(-1, n - 1)
        before[np.concatenate(([True], word[1:] != word[:-1]))] = -1
        rank = np.full(n, NONE, np.int32)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[follow[at] < n]
            rank[at] = self.ranks(sym[at], sym[follow[at]])
            at = at[rank[at] != NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            values, begins = np.unique(rank[at], return_index=True)
            for r, places in zip(values.tolist(), np.split(at, begins[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(places)

        look(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            at = at[alternating(np.concatenate(([False], follow[at[:-1]] == at[1:]))[:len(at)])]
            gone = follow[at]
            alive[gone], rank[gone] = False, NONE
            sym[at], follow[at] = self.made[r], follow[gone]
            on = follow[at] < n
            before[follow[at[on]]] = at[on]
            prior = before[at]
            look(np.unique(np.concatenate((at, prior[prior >= 0]))))
        return sym[alive], word[alive]


class Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: object) -> int:
        i = self[word] = len(self)
        return i


class Encoder:
    """Encodes stretches of texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.flat, self.begin, self.length = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, new: list) -> None:
        """Merges new words; an added token is a tuple of its string."""
        flat, sizes = self.v.merge([w if isinstance(w, str) else "" for w in new])
        added = [i for i, w in enumerate(new) if not isinstance(w, str)]
        if added:
            flat = np.insert(flat, np.cumsum(sizes)[added], [self.v.added[new[i][0]] for i in added])
            sizes[added] = 1
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(sizes) - sizes))
        self.length = np.concatenate((self.length, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.places) > KNOWN_WORDS:
            self.forget()
        where, ends = array("q"), [0]
        for text in texts:
            for k, piece in enumerate(self.v.cut(text)):
                where.extend(map(self.places.__getitem__, [(piece,)] if k % 2 else self.v.split(piece)))
            ends.append(len(where))
        if len(self.places) > len(self.length):
            self.learn(list(islice(self.places, len(self.length), None)))
        at = np.frombuffer(where, np.int64) if len(where) else np.zeros(0, np.int64)
        sizes = self.length[at]
        past = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[at] - (past - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.diff(np.concatenate(([0], past))[ends])


def text_of(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of some ids; bytes that are no UTF-8 become U+FFFD, ids outside
    the vocabulary nothing."""
    ids = ids[(ids >= 0) & (ids < v.size)]
    size = v.raw_len[ids]
    at = np.repeat(v.raw_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return v.raw[at].tobytes().decode("utf-8", "replace")


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``STRETCH`` code points."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STRETCH:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the ids of every row's whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in stretches(texts):
                ids, counts = encoder(texts[a:b])
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(each, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``tokens`` with the text of ``ids_col`` (null: empty) in its place, as ``text_col``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for batch in batches:
            texts = [text_of(v, x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64))
                     for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    src = tokens.select(*[c for c in tokens.columns if c != ids_col], ids_col)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(text_col, T.StringType())])
    names = schema.fieldNames()
    return src.mapInArrow(each, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of a round trip."""
    ids = encode(docs, id_col, text_col, path)
    counted = ids.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(counted, "ids", "decoded", path).select(
        id_col, "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
