"""Vocabularies and TF-IDF.

Sparse features are long tables ``(doc_id, term_id, weight)``; zeros are never
stored. Term ids follow a total order and are assigned by range partitioning
(``with_sequential_id``), never by a single-partition window, because the
vocabulary is not assumed to fit in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.text import text_or_empty, tfidf_tokens, words
from vulnxml.operators.ids import with_sequential_id
from vulnxml.session import write_and_read

# Terms whose id and idf every task knows. They bound a list, not the result.
TOP_TERMS = 1 << 16
# Special vocabulary entries and their ids.
UNK, UNK_ID = "<unk>", 0
PAD, PAD_ID = "<pad>", 1


def word_doc_freq(tokens: DataFrame, word_col: str = "word") -> DataFrame:
    """A4: (word, word_freq = corpus count, doc_freq = docs having the word).
    Two aggregations with map-side partial sums; no distinct-count expansion."""
    per_doc = tokens.groupBy("doc_id", word_col).agg(F.count(F.lit(1)).alias("_c"))
    return per_doc.groupBy(word_col).agg(F.sum("_c").cast("bigint").alias("word_freq"),
                                         F.count(F.lit(1)).cast("bigint").alias("doc_freq"))


def tfidf_term_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf) with the vectoriser's tokens."""
    toks = docs.select(F.col(id_col).alias("doc_id"), F.explode(tfidf_tokens(text_col)).alias("term"))
    return toks.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out by doc, those of a doc together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")


def _whole_docs(batches):
    """(rows, doc of each row from 0, first row of each doc), whole docs only;
    ``batches`` hold the doc in column 0 and have the rows of a doc together."""
    def split(b):
        code = b.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new = np.r_[True, code[1:] != code[:-1]]
        return b, np.cumsum(new) - 1, np.flatnonzero(new)

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        # The last doc may go on.
        if held and held[-1].column(0)[-1] == b.column(0)[-1]:
            held.append(b)
            continue
        b, _, first = split(pa.concat_batches([*held, b]))
        held = [b.slice(int(first[-1]))]
        if first[-1]:
            yield split(b.slice(0, int(first[-1])))
    if held:
        yield split(pa.concat_batches(held))


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``n`` lists of values, that lie in the order of their lists ``of``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def doc_terms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, terms, tf): one row per doc with its different terms, counted
    once where the doc lies and written, for ``tfidf_fit`` and ``tfidf_transform``."""
    dealt = _dealt(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def count(batches):
        for b, doc, first in _whole_docs(batches):
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            coded = b.column(1).flatten().dictionary_encode()
            k = max(1, len(coded.dictionary))
            key, tf = np.unique(np.repeat(doc, size) * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(first)), _lists(key // k, len(first), coded.dictionary.take(pa.array(key % k))),
                 _lists(key // k, len(first), pa.array(tf, pa.int64()))], ["doc_id", "terms", "tf"])

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return write_and_read(dealt.select("doc_id", tfidf_tokens("text").alias("terms")).mapInArrow(count, f"doc_id {kind}, terms array<string>, tf array<long>"), "doc-terms")


def tfidf_fit(train: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(term, term_id, df, idf) fitted on ``train`` only.
    idf = ln((1 + N) / (1 + df)) + 1; ids follow the terms' code point order.
    ``train`` may be rows of ``doc_terms``."""
    n_docs = train.select(id_col).distinct().count()
    terms = train.select(F.explode("terms").alias("term")) if "terms" in train.columns else tfidf_term_counts(train, text_col, id_col)
    df_ = terms.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df"))
    model = df_.withColumn("idf", F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + 1.0)
    return with_sequential_id(model, ["term"], "term_id")


def tfidf_transform(docs: DataFrame, model: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term_id, weight) = tf * idf, L2-normalised per doc; terms
    outside the model are dropped. Rows of ``doc_terms`` give a row per doc:
    (doc_id, term_ids, weights), ids ascending."""
    if "terms" in docs.columns:
        return _transformed_lists(docs, model)
    tf = tfidf_term_counts(docs, text_col, id_col)
    raw = tf.join(model.select("term", "term_id", "idf"), "term").select(
        "doc_id", "term_id", (F.col("tf") * F.col("idf")).alias("weight"))
    return l2_normalize(raw)


def _transformed_lists(counts: DataFrame, model: DataFrame) -> DataFrame:
    """A9 by doc. The ids and idf of the ``TOP_TERMS`` most frequent terms are
    known to every task, so that nearly all entries stay in the lists of their doc
    as ranks; the rows of rarer terms meet the model by term and go back to their doc."""
    spark = counts.sparkSession
    # At most TOP_TERMS rows reach the driver, whatever the vocabulary.
    found = model.orderBy(F.desc("df"), "term").limit(TOP_TERMS).select("term", "term_id", "idf").collect()
    top = spark.sparkContext.broadcast(([r["term"] for r in found], [r["term_id"] for r in found], [r["idf"] for r in found]))

    def ranked(batches, near):
        known = pa.array(top.value[0], pa.string())
        for b in batches:
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            terms, tf = b.column(1).flatten(), b.column(2).flatten()
            rank = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero((rank >= 0) == near)
            if near:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(of[at], b.num_rows, pa.array(rank[at], pa.int32())), _lists(of[at], b.num_rows, tf.take(pa.array(at)))],
                                                 ["doc_id", "ranks", "tf"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[at])), terms.take(pa.array(at)), tf.take(pa.array(at))], ["doc_id", "term", "tf"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    near = counts.mapInArrow(lambda batches: ranked(batches, True), f"doc_id {kind}, ranks array<int>, tf array<long>")
    far = (counts.mapInArrow(lambda batches: ranked(batches, False), f"doc_id {kind}, term string, tf long")
           .join(model.select("term", "term_id", "idf"), "term").select("doc_id", "term_id", (F.col("tf") * F.col("idf")).alias("weight")))
    rows = near.unionByName(far, allowMissingColumns=True)

    def weigh(batches):
        ids, idf = np.array(top.value[1], np.int64), np.array(top.value[2], np.float64)
        for b, doc, first in _whole_docs(batches):
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            rank = b.column(1).flatten().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(b.column(3).is_valid().to_numpy(zero_copy_only=False))
            of = np.r_[np.repeat(doc, size), doc[own]]
            term = np.r_[ids[rank], b.column(3).take(pa.array(own)).to_numpy(zero_copy_only=False)]
            weight = np.r_[b.column(2).flatten().to_numpy(zero_copy_only=False) * idf[rank], b.column(4).take(pa.array(own)).to_numpy(zero_copy_only=False)]
            order = np.lexsort((term, of))
            of, term, weight = of[order], term[order], weight[order]
            norm = np.sqrt(np.bincount(of, weight * weight, len(first)))
            weight = weight / np.where(norm > 0, norm, 1.0)[of]
            some = np.bincount(of, minlength=len(first)) > 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), _lists(of, len(first), pa.array(term, pa.int64())), _lists(of, len(first), pa.array(weight, pa.float64()))],
                                             ["doc_id", "term_ids", "weights"]).filter(pa.array(some))

    return _dealt(rows.select("doc_id", "ranks", "tf", "term_id", "weight")).mapInArrow(weigh, f"doc_id {kind}, term_ids array<long>, weights array<double>")


def l2_normalize(rows: DataFrame, id_col: str = "doc_id", weight_col: str = "weight") -> DataFrame:
    """A10: unit-length sparse rows; all-zero rows unchanged."""
    norm = F.sqrt(F.sum(F.col(weight_col) * F.col(weight_col)).over(Window.partitionBy(id_col)))
    return rows.withColumn(weight_col, F.when(norm > 0, F.col(weight_col) / norm).otherwise(F.col(weight_col)))


def lower_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word): lower-cased whitespace tokens (sequence models)."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(words(F.lower(text_or_empty(text_col)))).alias("pos", "word"))


def build_vocab(tokens: DataFrame, min_freq: int = 1) -> DataFrame:
    """(word, word_id, freq): <unk>=0, <pad>=1, then words by frequency
    desc, word asc, from id 2."""
    spark = tokens.sparkSession
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("freq")).filter(F.col("freq") >= min_freq)
    ranked = with_sequential_id(counts, [F.desc("freq"), F.asc("word")], "word_id", start=2)
    specials = spark.createDataFrame([(UNK, UNK_ID, 0), (PAD, PAD_ID, 0)], "word string, word_id long, freq long")
    return specials.unionByName(ranked.select("word", "word_id", "freq"))


def lookup_vocab(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, word, word_id); unknown words -> <unk> = 0. The tokens
    are shuffled once, by word; AQE splits the partition of a frequent one."""
    rows = tokens.select("doc_id", "pos", "word").join(vocab.select("word", "word_id"), "word", "left")
    return rows.select("doc_id", "pos", "word", F.coalesce("word_id", F.lit(UNK_ID).cast("long")).alias("word_id"))


def doc_sequences(ids: DataFrame) -> DataFrame:
    """(doc_id, ids): J5 output gathered per doc, in order. Rows are dealt out by
    doc as they are, which is less than lists gathered per doc before that."""
    return (ids.select("doc_id", "pos", "word_id").repartition("doc_id").groupBy("doc_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word_id"))), lambda s: s["word_id"]).alias("ids")))


def fix_length_tokens(ids: DataFrame, docs: DataFrame, length: int = 500) -> DataFrame:
    """Q3: per doc the word ids in order, cut to ``length`` or right-padded
    with <pad>. ``ids`` is J5 output; docs without tokens become all padding."""
    seq = doc_sequences(ids.filter(F.col("pos") < length)).withColumnRenamed("ids", "_ids")
    full = docs.select("doc_id").distinct().join(seq, "doc_id", "left").withColumn(
        "_ids", F.coalesce("_ids", F.array().cast("array<long>")))
    cut = F.slice("_ids", 1, length)
    return full.select("doc_id", F.concat(cut, F.array_repeat(F.lit(PAD_ID).cast("long"),
                                                              F.lit(length) - F.size(cut))).alias("ids"))
