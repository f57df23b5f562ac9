"""Packing token streams into fixed-length sequences by dynamic programming.

Within a partition documents keep their order. A window ends at a document or
sentence end, or, at a higher penalty, inside a long sentence.
Cost of a window: its padding (none if its length is a power of two) plus the
penalty of its end (none at a document's end) plus ``WINDOW_COST``. The least
cost over all ends within ``size`` tokens comes from a monotone queue, as the
padding is linear in the start; the few power-of-two lengths are looked up.
A partition is solved in segments of about ``SEGMENT`` tokens; the last windows
of a segment are solved again with the next one, so only the end of a partition
is padded. Rows are complete: every id of every text is in exactly one piece.

Null text counts as empty (the end id alone); repeated rows are packed each;
an empty table gives an empty result; nothing is kept from other columns.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, END_ID = 2048, 1
SEGMENT, SOLVED_AGAIN = 1 << 18, 8
SENTENCE_PENALTY, HARD_PENALTY, WINDOW_COST = 2, 24, 32
#: Sentences over twice this many ids may also be cut at each of its multiples.
HARD_STEP = 32
#: Shortest power-of-two length that is worth a window of its own.
LEAST_POWER = 1024
#: Runs of white space of this length are encoded apart.
SPACES = 50_000

class Encoder:
    """Ids of a text as little-endian 32-bit bytes, equal to those of the
    tokenizer file. The merging runs on the same vocabulary as ranks, which is
    several times faster; a text that holds an added token's string, or a run of
    ``SPACES`` spaces (beyond some 700,000 the rank merger's pattern ends the
    process), goes to the tokenizer itself, which is read when first needed."""

    def __init__(self, tokenizer_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(self.path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.spaces = re.compile(rf"\s{{{SPACES}}}").search
        self.stop = np.zeros(max(ranks.values()) + 2, bool)
        self.stop[[i for t, i in ranks.items() if t[-1:] in (b".", b"!", b"?", b"\n")]] = True

    @cached_property
    def full(self) -> "Tokenizer":  # noqa: F821
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if self.added(text) or len(text) >= SPACES and self.spaces(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(array("I", self.merge(text)), "<u4").tobytes()


def cut_windows(ends: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Window ends of least cost for a stream that starts at 0. ``ends``:
    allowed ends, ascending, the last is the stream's; gaps are ``size`` at most."""
    pos = np.concatenate(([0], ends))
    n = len(pos)
    jumps: list[list[int]] = [[]] * n
    k = 1 << (size.bit_length() - 1)
    k = k // 2 if k == size else k
    while k >= min(LEAST_POWER, size):
        at = np.searchsorted(pos, pos - k)
        hit = np.flatnonzero((pos >= k) & (pos[np.minimum(at, n - 1)] == pos - k))
        for j in hit.tolist():
            jumps[j] = [*jumps[j], int(at[j])]
        k //= 2
    p, pen = pos.tolist(), [0, *penalty.tolist()]
    cost, start = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n  # cost of the best packing up to a start, plus the start
    for j in range(1, n):
        here = p[j]
        while here - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - here
        for x in jumps[j]:
            if cost[x] < best:
                best, i = cost[x], x
        best += pen[j] + WINDOW_COST
        cost[j], start[j] = best, i
        key[j] = best = best + here
        while queue and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(p[j])
        j = start[j]
    return out[::-1]


def allowed_ends(ids: np.ndarray, doc_ends: np.ndarray, stop: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """All ends a window may have, with their penalties."""
    mark = np.zeros(len(ids) + 1, np.int16)
    mark[1:][stop[np.minimum(ids, len(stop) - 1)]] = SENTENCE_PENALTY + 1
    mark[doc_ends] = 1
    at = np.flatnonzero(mark)
    gaps = np.diff(np.concatenate(([0], at)))
    step = min(HARD_STEP, size)
    for i in np.flatnonzero(gaps > min(2 * step, size)):
        mark[at[i] - gaps[i] + step:at[i]:step] = HARD_PENALTY + 1
    at = np.flatnonzero(mark)
    return at, mark[at] - 1


PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID,
         tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of a document: its place in the document (``start``,
    ``length``), CRC-32 of its ids, the document's length and its place in the
    sequences (``sequence_id``, ``offset``). Sequence ids are unique over all
    partitions."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path, ranks_path)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        tail = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, int, int, bytes]] = []  # id, ids before, ids of the document, ids
        held_ids = 0

        def solve(final: bool) -> pa.RecordBatch:
            nonlocal sequence, held, held_ids
            raw = b"".join(h[3] for h in held)
            ids = np.frombuffer(raw, "<u4")
            doc_ends = np.cumsum([len(h[3]) // 4 for h in held])
            windows = cut_windows(*allowed_ends(ids, doc_ends, encode.stop, size), size)
            if not final:
                windows = windows[:max(1, len(windows) - SOLVED_AGAIN)]
            w = np.array(windows)
            done = windows[-1]
            cuts = np.unique(np.concatenate((w, doc_ends[doc_ends <= done])))
            begins = np.concatenate(([0], cuts[:-1]))
            doc = np.searchsorted(doc_ends, begins, side="right")
            win = np.searchsorted(w, begins, side="right")
            doc_begin = np.concatenate(([0], doc_ends[:-1]))
            before = np.array([h[1] for h in held])
            total = np.array([h[2] for h in held])
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), cuts.tolist())]
            cols = [pa.array([held[i][0] for i in doc.tolist()], pa.int64()),
                    before[doc] + begins - doc_begin[doc], cuts - begins, crc, total[doc], sequence + win,
                    begins - np.concatenate(([0], w))[win]]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in PIECES.split(", ")])
            sequence += len(windows)
            first = int(np.searchsorted(doc_ends, done, side="right"))
            rest = held[first:]
            if rest and done > doc_begin[first]:
                used = int(done - doc_begin[first])
                rest[0] = (rest[0][0], rest[0][1] + used, rest[0][2], rest[0][3][4 * used:])
            held, held_ids = rest, sum(len(h[3]) // 4 for h in rest)
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                held.append((key.as_py(), 0, n, ids))
                held_ids += n
                if held_ids >= SEGMENT:
                    yield solve(False)
        while held:
            yield solve(True)

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(each, PIECES).withColumnRenamed("id", id_col)
