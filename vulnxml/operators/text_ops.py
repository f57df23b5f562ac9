"""Token-level text operators: tokenize (G1), nouns only (P2), token
frequencies (A5), frequent words (A6), frequent-word removal (A7), split
selection (P16).

Tokens are exploded with their position, so order survives any shuffle;
re-assembly sorts a doc's own (pos, word) pairs, which is bounded by the
size of that one input text.

Joins on a word have shuffles right below them on both sides (no aggregate in
between), which is what lets AQE split the partition of a word that all texts have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnxml.functions.text import basic_cleaning, words

# Tags kept by the noun filter.
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
SPLITS = ("train", "valid", "test")


def tokenize(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", clean: bool = True) -> DataFrame:
    """G1: (doc_id, pos, word) for whitespace tokens (of the cleaned text)."""
    text = basic_cleaning(text_col) if clean else F.col(text_col)
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(words(text)).alias("pos", "word"))


def word_positions(tokens: DataFrame) -> DataFrame:
    """(doc_id, word, positions): a doc's tokens gathered per word, before a
    join on the word (bounded by that doc)."""
    return tokens.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))


def reassemble(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", out_col: str = "text") -> DataFrame:
    """Join each doc's surviving words (``word_positions`` rows) back into one
    text in position order; docs with no token left get ''."""
    joined = (tokens.select(id_col, "word", F.explode("positions").alias("pos")).groupBy(id_col)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))),
                                            lambda s: s["word"]), " ").alias(out_col)))
    return (docs.select(id_col).distinct().join(joined, id_col, "left")
            .select(id_col, F.coalesce(out_col, F.lit("")).alias(out_col)))


def nouns_only(df: DataFrame, tags: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep the tokens tagged as nouns, in order. ``tags`` is (word, tag),
    the output of any part-of-speech tagger (not built here)."""
    toks = tokenize(df, text_col, id_col, clean=False).withColumn("word", F.lower("word"))
    nouns = tags.filter(F.col("tag").isin(*NOUN_TAGS)).select("word")
    kept = word_positions(toks).join(nouns, "word", "left_semi")
    out = reassemble(kept, df.select(F.col(id_col).alias("doc_id")), "doc_id", "text")
    return out.select("doc_id", basic_cleaning("text").alias("text"))


def token_frequencies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A5: per doc each cleaned token with its count, ranked by count desc then
    first appearance -> (doc_id, word, cnt, first_pos, rank)."""
    # The texts are dealt out by doc, once; counts and ranks are taken where they lie.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    toks = tokenize(df.select(id_col, text_col).repartition(n, id_col), text_col, id_col)
    per = toks.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "first_pos")
    return per.withColumn("rank", F.row_number().over(w))


def frequent_words(df: DataFrame, proportion: float, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A6 per document: the first floor(proportion * distinct words) of A5."""
    freq = token_frequencies(df, text_col, id_col)
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return (freq.withColumn("_n", n).filter(F.col("rank") <= F.floor(F.col("_n") * F.lit(proportion)))
            .select("doc_id", "word", "cnt", "rank"))


def corpus_frequent_words(df: DataFrame, proportion: float, text_col: str = "text",
                          id_col: str = "doc_id") -> DataFrame:
    """A6 over the corpus: the top floor(proportion * vocabulary) words by count
    (ties by word). The list grows with the vocabulary, so it is cut by a
    range-partitioned rank, not by a global limit in one task."""
    from vulnxml.operators.ids import with_sequential_id
    counts = tokenize(df, text_col, id_col).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    keep = int(counts.count() * proportion)
    ranked = with_sequential_id(counts, [F.desc("cnt"), F.asc("word")], "_rank")
    return ranked.filter(F.col("_rank") < keep).select("word", "cnt")


def remove_frequent_words(df: DataFrame, stop_words: DataFrame, text_col: str = "text",
                          id_col: str = "doc_id") -> DataFrame:
    """Delete the listed words from each cleaned text, keeping order."""
    toks = tokenize(df, text_col, id_col)
    kept = word_positions(toks).join(stop_words.select("word"), "word", "left_anti")
    return reassemble(kept, df.select(F.col(id_col).alias("doc_id")), "doc_id", "text")


def select_split(corpus: DataFrame, mode: str) -> DataFrame:
    """Rows of one split; any other mode is an error."""
    if mode not in SPLITS:
        raise ValueError(f"unknown split {mode!r}")
    return corpus.filter(F.col("split") == mode)
