"""Spark types of tokens."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import types as T

CHAR_MAP = T.ArrayType(T.StructType([T.StructField("orig", T.ShortType(), False), T.StructField("norm", T.ShortType(), False)]), False)

TOKEN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("separator_kind", T.StringType(), True),
        T.StructField("lemma", T.StringType(), False),
        T.StructField("char_start", T.IntegerType(), False),
        T.StructField("char_end", T.IntegerType(), False),
        T.StructField("byte_start", T.IntegerType(), False),
        T.StructField("byte_end", T.IntegerType(), False),
        T.StructField("char_map", CHAR_MAP, True),
        T.StructField("script", T.StringType(), False),
        T.StructField("language", T.StringType(), True),
    ]
)
#: A token with the slice of the text that it stands for.
ORIGINAL = T.StructType([T.StructField("original", T.StringType(), False), T.StructField("token", TOKEN, False)])

TOKENS = T.ArrayType(TOKEN, False)
RECONSTRUCTED = T.ArrayType(ORIGINAL, False)


def tokens(fields: Sequence[str] = ()) -> T.ArrayType:
    """Tokens with these fields alone; with all, if none are named."""
    return T.ArrayType(T.StructType([TOKEN[name] for name in fields]), False) if fields else TOKENS


def reconstructed(fields: Sequence[str] = ()) -> T.ArrayType:
    return T.ArrayType(T.StructType([ORIGINAL["original"], T.StructField("token", tokens(fields).elementType, False)]), False)


STRINGS = T.ArrayType(T.StringType(), False)
COUNTS = T.ArrayType(T.StructType([T.StructField("lemma", T.StringType(), False), T.StructField("n", T.LongType(), False)]), False)

ARROW_CHAR_MAP = pa.list_(pa.struct([("orig", pa.int16()), ("norm", pa.int16())]))
