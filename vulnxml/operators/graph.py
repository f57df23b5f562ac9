"""Word / document graph (G2-G7) without materialising sliding windows.

A doc of L tokens and window w has M + 1 windows, M = max(L - w, 0), with
starts 0..M. Closed forms (exact, equal to enumerating the windows):

* a word at positions p1 < p2 < ... is in the windows whose start lies in
  the union of [max(0, p - w + 1), min(p, M)];
* positions a < b (b - a < w) share min(a, M) - max(0, b - w + 1) + 1 windows.

Nearly all pairs have a frequent word at one end, so a pair is kept at its rarer
word: a task sums the pairs of a stretch of tokens (NumPy, bounded memory) and
gives for each word the list of its more frequent partners: gaps between their
ranks, and counts, in as few bytes as each needs. Only these lists are shuffled,
by word; they arrive in order and are summed a slice at a time, and a bounded list
of the most frequent words, known to every task, turns ranks into words. Pairs of two words outside that list are few and travel as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.text import SPACE_SET, text_or_empty, words
from vulnxml.operators.ids import with_sequential_id
from vulnxml.session import cut_lineage, write_and_read

WINDOW = 20
# Words that every task knows by rank. They bound a list, not the result.
TOP_WORDS = 1 << 16
# Tokens whose pairs are summed in one go.
STRETCH = 1 << 19
# Pairs, or bytes of lists, that a task handles in one go after that.
PIECE = 1 << 18
# Characters that are not word characters or whitespace are deleted (as P1).
NON_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE_SET}]"


def doc_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", clean: bool = True, dealt: bool = False) -> DataFrame:
    """(doc_id, words array, n_tokens) - computed in-row, nothing collected.
    ``dealt``: dealt out by doc as texts, which take a fraction of their words,
    for what groups by doc or writes the words."""
    if dealt:
        docs = docs.select(id_col, text_col).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    text = F.regexp_replace(F.lower(text_or_empty(text_col)), NON_WORD, "") if clean else F.col(text_col)
    return (docs.select(F.col(id_col).alias("doc_id"), words(text).alias("words"))
            .withColumn("n_tokens", F.size("words")))


def token_windows(dw: DataFrame, w: int = WINDOW) -> DataFrame:
    """Windows per doc (1 when L <= w, else L - w + 1; an empty doc has one)."""
    return dw.select("doc_id", (F.greatest(F.col("n_tokens") - w, F.lit(0)) + 1).cast("bigint").alias("n_windows"))


def total_windows(dw: DataFrame, w: int = WINDOW) -> DataFrame:
    return token_windows(dw, w).agg(F.sum("n_windows").cast("bigint").alias("n_windows"))


def word_window_freq(dw: DataFrame, w: int = WINDOW) -> DataFrame:
    """(word, window_freq) = windows containing the word (once per window)."""
    toks = dw.select("doc_id", "n_tokens", F.posexplode("words").alias("pos", "word"))
    m = F.greatest(F.col("n_tokens") - w, F.lit(0))
    hi = F.least(F.col("pos"), m)
    lo = F.greatest(F.lit(0), F.col("pos") - w + 1)
    prev_hi = F.lag(hi).over(Window.partitionBy("doc_id", "word").orderBy("pos"))
    lo_new = F.when(prev_hi.isNull(), lo).otherwise(F.greatest(lo, prev_hi + 1))
    cover = toks.withColumn("_c", F.greatest(hi - lo_new + 1, F.lit(0)))
    return cover.groupBy("word").agg(F.sum("_c").cast("bigint").alias("window_freq"))


def window_freq_in_row(dw: DataFrame, w: int = WINDOW) -> DataFrame:
    """G3 in-row: each doc's (word, pos) pairs sorted, each compared with
    its predecessor to take the union of covered window starts; only the
    per-word sums are shuffled (after map-side partial aggregation)."""
    n = F.col("n_tokens")
    srt = F.sort_array(F.arrays_zip(F.col("words").alias("w"), F.sequence(F.lit(0), n - 1).alias("p")))
    per = dw.filter(n > 0).select("n_tokens", srt.alias("s"))
    prev_w = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("s.w"), 1, n - 1))
    prev_p = F.concat(F.array(F.lit(None).cast("int")), F.slice(F.col("s.p"), 1, n - 1))
    z = F.arrays_zip(F.col("s.w").alias("w"), F.col("s.p").alias("p"), prev_w.alias("pw"), prev_p.alias("pp"))
    rows = per.select("n_tokens", F.explode(z).alias("z"))
    m = F.greatest(n - w, F.lit(0))
    hi = F.least(F.col("z.p"), m)
    lo = F.greatest(F.lit(0), F.col("z.p") - w + 1)
    lo = F.when(F.col("z.pw") == F.col("z.w"), F.greatest(lo, F.least(F.col("z.pp"), m) + 1)).otherwise(lo)
    return (rows.select(F.col("z.w").alias("word"), F.greatest(hi - lo + 1, F.lit(0)).alias("c"))
            .groupBy("word").agg(F.sum("c").cast("bigint").alias("window_freq")))


def written_docs(dw: DataFrame) -> DataFrame:
    """The tokenised docs, written once, as they are dealt out: by doc
    (``doc_words``), which evens out very unequal doc lengths."""
    return write_and_read(dw.select("doc_id", "n_tokens", "words"), "words")


def top_words(docs: DataFrame) -> Broadcast:
    """The ``TOP_WORDS`` most frequent words, most frequent first, for every task."""
    counts = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # At most TOP_WORDS rows reach the driver, whatever the vocabulary.
    found = counts.orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    return docs.sparkSession.sparkContext.broadcast([r["word"] for r in found])


def _numbered(flat: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """(number of each token, words by number, their ranks, how many are known):
    known words come first, by rank, the others by code point, so that the order
    of two words is the same in every task."""
    coded = flat.dictionary_encode()
    names = coded.dictionary
    rank = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    by_name = np.empty(len(names), np.int64)
    by_name[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    order = np.argsort(np.where(rank >= 0, rank, len(known) + by_name))
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    return number[coded.indices.to_numpy(zero_copy_only=False)], names.take(pa.array(order)), rank[order], int((rank >= 0).sum())


def _pair_sums(words_col: pa.Array, known: pa.Array, w: int, rare: bool, stretch: int):
    """(words by number, ranks, rarer word, other word, count) per piece of a
    stretch of tokens, sorted by the words' numbers; a stretch has a pair once.
    ``rare``: pairs of two unknown words, else those with a known one."""
    size = pc.fill_null(pc.list_value_length(words_col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    token, names, ranks, n_known = _numbered(words_col.flatten(), known)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(token)) - (np.cumsum(size) - size)[doc]
    last = np.maximum(size - w, 0)[doc]
    bits, k = w.bit_length(), max(1, len(names))
    room = np.empty((w - 1) * min(stretch, len(token)), np.int64)
    for at in range(0, len(token), stretch):
        n = 0
        for d in range(1, w):
            i = np.arange(at, max(at, min(at + stretch, len(token) - d)))
            x, y = token[i], token[i + d]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            take = np.flatnonzero((doc[i] == doc[i + d]) & (x != y) & ((lo >= n_known) if rare else (lo < n_known)))
            i = i[take]
            shared = np.minimum(pos[i], last[i]) - np.maximum(0, pos[i] + d - w + 1) + 1
            room[n:n + len(take)] = (hi[take] * k + lo[take] << bits) | shared
            n += len(take)
        keys = room[:n]
        keys.sort()
        start = 0
        while start < n:
            # A piece ends where its last pair ends.
            end = int(np.searchsorted(keys, ((keys[min(start + PIECE, n) - 1] >> bits) + 1) << bits))
            pair = keys[start:end] >> bits
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            yield names, ranks, pair[first] // k, pair[first] % k, np.add.reduceat(keys[start:end] & ((1 << bits) - 1), first)
            start = end


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of at least 0 in as few bytes of 7 bits as each needs, and how
    many it has; the last byte of a number is below 128."""
    size = np.ones(len(values), np.int64)
    while (more := values >> 7 * size.max(initial=1)).any():
        size[more > 0] += 1
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(size.max(initial=0)):
        has = size > j
        out[at[has] + j] = values[has] >> 7 * j & 127 | np.where(size[has] > j + 1, 128, 0)
    return out, size


def _unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_packed`` and the place of each one's last byte."""
    end = np.flatnonzero(data < 128)
    start = np.r_[0, end + 1][:len(end)]
    out = np.zeros(len(end), np.int64)
    for j in range((end - start).max(initial=-1) + 1):
        has = start + j <= end
        out[has] |= (data[start[has] + j].astype(np.int64) & 127) << 7 * j
    return out, end


def _as_lists(word: np.ndarray, ranks: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(word of each list, its bytes): gaps between ascending ranks and counts in
    turns. The rows of a word lie together."""
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    values = np.empty(2 * len(word), np.int64)
    values[0::2] = np.r_[ranks[:1], ranks[1:] - ranks[:-1]]
    values[2 * starts] = ranks[starts]
    values[1::2] = cnt
    data, size = _packed(values)
    offsets = np.r_[0, np.cumsum(size)][np.r_[2 * starts, len(values)]].astype(np.int32)
    return word[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _from_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the list, rank, count) of every entry; a null has none."""
    size = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, end = _unpacked(np.frombuffer(b"".join(x for x in lists.to_pylist() if x), np.uint8))
    gaps = values[0::2]
    of = np.searchsorted(np.cumsum(size), end[0::2], side="right")
    total = np.cumsum(gaps)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
    before = np.repeat(total[starts] - gaps[starts], np.diff(np.r_[starts, len(of)]))
    return of, total - before, values[1::2]


def _common_lists(docs: DataFrame, top: Broadcast, w: int) -> DataFrame:
    """(word, pairs): per word and stretch its known, more frequent partners, as
    ranks, and how many windows they share."""
    stretch = STRETCH

    def each(batches):
        known = pa.array(top.value, pa.string())
        for b in batches:
            for names, ranks, hi, lo, cnt in _pair_sums(b.column(0), known, w, False, stretch):
                word, lists = _as_lists(hi, ranks[lo], cnt)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(word)), lists], ["word", "pairs"])
    return docs.select("words").mapInArrow(each, "word string, pairs binary")


def _rare_pairs(docs: DataFrame, top: Broadcast, w: int) -> DataFrame:
    """(word, other, cnt): the pairs of two words outside ``top``, summed."""
    stretch = STRETCH

    def each(batches):
        known = pa.array(top.value, pa.string())
        for b in batches:
            for names, _, hi, lo, cnt in _pair_sums(b.column(0), known, w, True, stretch):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(hi)), names.take(pa.array(lo)), pa.array(cnt, pa.int64())], ["word", "other", "cnt"])
    return (docs.select("words").mapInArrow(each, "word string, other string, cnt long")
            .groupBy("word", "other").agg(F.sum("cnt").cast("bigint").alias("cnt")))


def _summed(lists: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, fa, rank, cnt): the pairs of the lists, summed, with the facts
    (word, window_freq, name) of their rarer word. Lists and facts are dealt out
    by word, so that a task sums about as many pairs whatever the corpus, and lie
    in order there: a task holds a slice of them and the sums of one word."""
    n = docs.agg(F.sum("n_tokens")).first()[0] or 0
    kind = facts.schema["name"].dataType.simpleString()
    rows = lists.select("word", "pairs", F.lit(None).cast("long").alias("fa"), F.lit(None).cast(kind).alias("name")).unionByName(
        facts.select("word", F.lit(None).cast("binary").alias("pairs"), F.col("window_freq").alias("fa"), "name"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // STRETCH)

    def add(batches):
        held = None
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1
            for at, end in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
                rows = b.slice(int(at), int(end - at))
                rows = pa.concat_batches([held, rows]) if held is not None else rows
                coded = rows.column(0).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                of, rank, cnt = _from_lists(rows.column(1))
                key = code[of] << 32 | rank
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
                cnt = np.add.reduceat(cnt[order], first) if len(first) else cnt
                word, rank = key[first] >> 32, key[first] & (1 << 32) - 1
                # The row that has the facts of each word, if it has come.
                fact = np.full(len(coded.dictionary), -1)
                has = np.flatnonzero(rows.column(2).is_valid().to_numpy(zero_copy_only=False))
                fact[code[has]] = has
                done = word < len(fact) - 1
                yield _with_facts(rows, fact, word[done], rank[done], cnt[done])
                # The last word may go on.
                last = ~done
                _, lists = _as_lists(word[last], rank[last], cnt[last]) if last.any() else (None, pa.nulls(1, pa.binary()))
                own = pa.array([fact[-1] if fact[-1] >= 0 else None], pa.int64())
                held = pa.RecordBatch.from_arrays([coded.dictionary[-1:], lists, rows.column(2).take(own), rows.column(3).take(own)], schema=rows.schema)
        if held is not None:
            of, rank, cnt = _from_lists(held.column(1))
            yield _with_facts(held, np.zeros(1, np.int64), of, rank, cnt)

    def _with_facts(rows, fact, word, rank, cnt):
        at = pa.array(fact[word], pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(3).take(at), rows.column(2).take(at), pa.array(rank, pa.int32()), pa.array(cnt, pa.int64())],
                                          ["name", "fa", "rank", "cnt"])

    return rows.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(add, f"name {kind}, fa long, rank int, cnt long")


def _ranked(top: Broadcast, docs: DataFrame) -> DataFrame:
    """(rank, top_word): at most ``TOP_WORDS`` rows."""
    return docs.sparkSession.createDataFrame(list(enumerate(top.value)), "rank int, top_word string")


def pair_window_count(dw: DataFrame, w: int = WINDOW, mirrored: bool = True) -> DataFrame:
    """(word_a, word_b, cnt) = over all windows, the positional pairs of
    different words, counted in both orders (repeats count)."""
    docs = written_docs(dw)
    top = top_words(docs)
    facts = docs.select(F.explode("words").alias("word")).distinct().select("word", F.lit(0).cast("long").alias("window_freq"), F.col("word").alias("name"))
    common = (_summed(_common_lists(docs, top, w), facts, docs).join(F.broadcast(_ranked(top, docs)), "rank")
              .select(F.col("top_word").alias("word_a"), F.col("name").alias("word_b"), "cnt"))
    canon = common.unionByName(_rare_pairs(docs, top, w).select(F.col("other").alias("word_a"), F.col("word").alias("word_b"), "cnt"))
    return _both_orders(canon, "word_a", "word_b", "cnt") if mirrored else canon


def _both_orders(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Each pair in both orders, from one evaluation of ``pairs``."""
    ends = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    return (pairs.select(F.explode(ends).alias("e"), value)
            .select(F.col("e.x").alias(a), F.col("e.y").alias(b), value))


def pmi_named(docs: DataFrame, facts: DataFrame, w: int = WINDOW) -> DataFrame:
    """(a, b, pmi) in both orders, pmi > 0, with the name (word or node id)
    that ``facts`` (word, window_freq, name) has for each end."""
    n = float(docs.agg(F.sum(F.greatest(F.col("n_tokens") - w, F.lit(0)) + 1)).first()[0] or 0)
    top = top_words(docs)
    fa = facts.select("word", F.col("window_freq").alias("fa"), F.col("name").alias("na"))
    fb = facts.select(F.col("word").alias("other"), F.col("window_freq").alias("fb"), F.col("name").alias("nb"))
    known = write_and_read(_ranked(top, docs).withColumnRenamed("top_word", "other").join(fb, "other").select("rank", "fb", "nb"), "top")
    # The facts of the rarer word meet its lists, those of the other one a bounded table.
    common = (_summed(_common_lists(docs, top, w), facts, docs).join(F.broadcast(known), "rank")
              .select(F.col("name").alias("na"), "nb", "fa", "fb", "cnt"))
    rare = _rare_pairs(docs, top, w).join(fa, "word").join(fb, "other").select("na", "nb", "fa", "fb", "cnt")
    pmi = F.log((F.col("cnt") / F.lit(n)) / (F.col("fa") * F.col("fb") / F.lit(n * n)))
    edges = common.unionByName(rare).select(F.col("na").alias("a"), F.col("nb").alias("b"), pmi.alias("pmi")).filter("pmi > 0")
    return _both_orders(edges, "a", "b", "pmi")


def pmi_edges(dw: DataFrame, w: int = WINDOW) -> DataFrame:
    """(word_a, word_b, pmi) with pmi = ln((c/n) / (fa*fb/n^2)) > 0, both orders."""
    docs = written_docs(dw)
    facts = write_and_read(window_freq_in_row(docs, w).withColumn("name", F.col("word")), "facts")
    return pmi_named(docs, facts, w).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), "pmi")


def _term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, word, tf): docs are dealt out by id, so that words are counted
    where they lie and tokens are not shuffled."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.select("doc_id", "words").repartition(parts, "doc_id").select("doc_id", F.explode("words").alias("word"))
            .groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf")))


def tfidf_edges(dw: DataFrame) -> DataFrame:
    """Doc-word edges, weight = raw tf * ln(N / df) over all docs."""
    n_docs = dw.count()
    tf = write_and_read(_term_counts(dw), "tf")
    # Both are written, so that the join has plain shuffles below it: AQE can then
    # split a word that all docs have. A part of the vocabulary is hashed, as
    # sorting every row by its word takes longer.
    df_ = write_and_read(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "df")
    return (tf.join(df_.hint("shuffle_hash"), "word")
            .select("doc_id", "word", (F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("weight")))


def assemble_graph(dw_split: DataFrame, w: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Node ids = train docs (by doc_index), then words (code point order),
    then test docs; one edge table (src, dst, weight, kind).

    dw_split: doc_words output plus ``split`` and ``doc_index`` (D3)."""
    # The small per-doc node facts and the words are materialised apart.
    docs = cut_lineage(dw_split.select("doc_id", "split", "doc_index"))
    n_train = docs.filter("split = 'train'").count()
    words_ = written_docs(dw_split)
    n_docs = words_.count()
    # From the docs as they come, dealt out as texts: the written words would be shuffled whole.
    tf = write_and_read(dw_split.select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df_ = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # Word node ids follow code point order: numbered on the (vocabulary-sized) table.
    facts = write_and_read(window_freq_in_row(words_, w).join(df_, "word"), "facts")
    wnode = write_and_read(with_sequential_id(facts, ["word"], "word_index")
                           .select("word", "window_freq", "df", (F.col("word_index") + n_train).alias("node_id")), "word-nodes")
    n_vocab = wnode.count()
    doc_nodes = docs.select(
        "doc_id", F.when(F.col("split") == "train", F.col("doc_index"))
        .otherwise(F.col("doc_index") + n_train + n_vocab).alias("node_id"),
        F.when(F.col("split") == "train", "train_doc").otherwise("test_doc").alias("kind"),
        F.col("doc_id").cast("string").alias("name"))
    word_nodes = wnode.select(F.lit(None).cast("long").alias("doc_id"), "node_id", F.lit("word").alias("kind"),
                              F.col("word").alias("name"))
    nodes = doc_nodes.unionByName(word_nodes)
    pmi = pmi_named(words_, wnode.withColumnRenamed("node_id", "name"), w).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), F.col("pmi").alias("weight"), F.lit("pmi").alias("kind"))
    tfidf = (tf.join(wnode, "word")
             .select("doc_id", F.col("node_id").alias("dst"), (F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("weight"))
             .join(doc_nodes.select("doc_id", F.col("node_id").alias("src")), "doc_id")
             .select("src", "dst", "weight", F.lit("tfidf").alias("kind")))
    return nodes, pmi.unionByName(tfidf)
