"""Relational analytics over tokens.

Each takes a table of words (one row a word: id columns, pos, lemma) or of texts.
What concerns one text alone is made in its own row; what is left is one aggregation
by term. Counts are summed over spans of texts before they leave the Python worker, so
a word in every text sends one row a span; pairs of words, of which most stand there once
or twice, are not combined a second time before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokenizer import Tokenizer


def words(texts: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: Tokenizer | None = None) -> DataFrame:
    """keep, pos, lemma: one row a word token (pos counts words)."""
    return texts.select(*keep, F.posexplode((tokenizer or Tokenizer()).lemmas(text_col)).alias("pos", "lemma"))


def vocabulary(words_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return words_.groupBy(*by, "lemma").agg(F.count("*").alias("n"))


def top_words(words_: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k most frequent words of each group; ties by word."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "lemma")
    return vocabulary(words_, by).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def document_frequency(texts: DataFrame, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """lemma, df: the tokenizer counts the texts that have a word over spans of texts."""
    return texts.select(F.inline((tokenizer or Tokenizer()).text_counts(text_col))).groupBy(F.col("key").alias("lemma")).agg(F.sum("n").alias("df"))


def ngram_counts(texts: DataFrame, n: int = 2, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """gram, n: runs of n words of one text, counted over spans of texts."""
    counts = texts.select(F.inline((tokenizer or Tokenizer()).gram_counts(text_col, n)))
    return counts.repartition("key").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n"))


def context_lengths(texts: DataFrame, by: tuple[str, ...], text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """by, context, n_words: words between hard separators (contexts without words are left out), a text at a time: no shuffle."""
    rows = texts.select(*by, F.posexplode((tokenizer or Tokenizer()).context_sizes(text_col)).alias("context", "n"))
    return rows.filter("n > 0").select(*by, F.col("context").cast("long").alias("context"), F.col("n").cast("long").alias("n_words"))


def proximity(texts: DataFrame, within: int = 3, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """first, second, n: word pairs at most within words apart in one context, counted over spans of texts."""
    counts = texts.select(F.inline((tokenizer or Tokenizer()).near_counts(text_col, within))).repartition("key")
    told = F.substring_index("key", ":", 1)
    begin, size = F.char_length(told) + 2, told.cast("int")
    first, second = F.substring("key", begin, size), F.substring("key", begin + size, F.char_length("key"))
    return counts.groupBy("key").agg(F.sum("n").alias("n")).select(first.alias("first"), second.alias("second"), "n")


def tf_idf(texts: DataFrame, id_col: str, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """id, lemma, tf, df: a word's count in a text is made in the text's own row.

    df is grouped by lemma; with a second key both sides are shuffled for the join, and AQE can split a word of all texts.
    """
    t = tokenizer or Tokenizer()
    terms = texts.select(id_col, F.inline(t.lemma_counts(text_col))).withColumn("h", F.xxhash64("lemma"))
    df = document_frequency(texts, text_col, t).withColumn("h", F.xxhash64("lemma"))
    return terms.join(df, ["lemma", "h"]).select(id_col, "lemma", F.col("n").alias("tf"), "df")
