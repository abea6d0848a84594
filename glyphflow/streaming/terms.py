"""Streams of texts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokenizer import Tokenizer


def tokenize_stream(stream: DataFrame, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row a token; keeps no state, so it holds for streams and tables alike."""
    return (tokenizer or Tokenizer()).explode(stream, text_col)


def term_counts(stream: DataFrame, time_col: str, text_col: str, window: str, late: str, slide: str | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """window, lemma, n: words by event-time window; rows later than late are dropped by the watermark."""
    words = stream.withWatermark(time_col, late).select(time_col, F.explode((tokenizer or Tokenizer()).lemmas(text_col)).alias("lemma"))
    return words.groupBy(F.window(time_col, window, slide), "lemma").agg(F.count("*").alias("n"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local session may go without."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(at or 'file://' + tempfile.gettempdir() + '/glyphflow-streams').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(counts: DataFrame, path: str) -> DataFrame:
    """Runs a streaming aggregation until its input is used up; its last result is the table at path."""
    spark = counts.sparkSession

    def save(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    run = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)
