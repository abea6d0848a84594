"""Lexicons and variant tables come from files of any store that Spark reads.

They are dictionaries of bounded size (a few MB); the readers check that before
they bring one to the driver.  Larger tables of words stay tables: see
functions.mark_stop_words and functions.map_variants, which join them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a dictionary at most.
LARGEST = 2_000_000

KVARIANT = T.StructType([T.StructField("source", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("destination", T.StringType())])
#: Relations known; others are skipped.
RELATIONS = {"wrong!": "wrong", "sem": "semantic_variant", "simp": "simplified", "old": "old", "=": "equal"}


def _entries(rows: DataFrame) -> list:
    if rows.limit(LARGEST + 1).count() > LARGEST:
        raise ValueError(f"a dictionary of more than {LARGEST} entries")
    return rows.collect()


def read_texts(spark: SparkSession, path: str, format: str = "parquet", text_col: str = "text") -> DataFrame:
    """A DataFrame with a text column from parquet, json, orc, csv (with header) or text files."""
    if format == "text":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", text_col)
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    return reader.format(format).load(path)


def read_lexicon(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Words, one a line; for the Chinese segmenter with a tab and a frequency."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct()
    return tuple(sorted(r[0] for r in _entries(rows)))


def read_words(rows: DataFrame) -> tuple[str, ...]:
    """The distinct words of a table's first column (of a dictionary's size)."""
    kept = rows.select(F.col(rows.columns[0]).cast("string").alias("w")).filter("w IS NOT NULL").distinct()
    return tuple(sorted(r[0] for r in _entries(kept)))


def read_stop_words(spark: SparkSession, path: str) -> frozenset[str]:
    return frozenset(read_lexicon(spark, path))


def kvariants_etl(spark: SparkSession, path: str) -> DataFrame:
    """Raw tab-separated table to (source, relation, destination): the first character of either side."""
    raw = spark.read.schema("lhs string, relation string, rhs string").option("sep", "\t").option("quote", "").csv(path)
    first = lambda c: F.substring(F.trim(c), 1, 1)
    return raw.select(first("lhs").alias("source"), F.trim("relation").alias("relation"), first("rhs").alias("destination")).filter("source <> '' AND destination <> ''")


def read_kvariants(rows: DataFrame) -> tuple[tuple[str, str], ...]:
    """Pairs (source, destination) for the builder; unknown relations are skipped, of a repeated source the last stays."""
    kept = rows.filter(F.col("relation").isin(*RELATIONS)).select("source", "destination")
    return tuple(dict((r[0], r[1]) for r in _entries(kept)).items())
