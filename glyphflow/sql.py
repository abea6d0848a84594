"""SQL functions: tokenize, segment, segment_str, normalize_text, detect_script, detect_language,
original_lengths, and tokenize_rows for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, schema
from .config import TokenizerConfig
from .operators import tokenizer as op


#: functions.original_lengths as an SQL function, of built-in ones.
_STEP = "CASE WHEN a.seen < num_bytes THEN named_struct('chars', a.chars + 1, 'bytes', a.bytes + {0}, 'seen', a.seen + {1}) ELSE a END"
_ZERO = "named_struct('chars', 0, 'bytes', 0, 'seen', 0)"
_FINISH = "a -> named_struct('chars', a.chars, 'bytes', a.bytes)"
_ORIGINAL_LENGTHS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION original_lengths(token {schema.TOKEN.simpleString()}, num_bytes INT)
RETURNS STRUCT<chars: INT, bytes: INT>
RETURN CASE WHEN token.char_map IS NOT NULL
    THEN aggregate(token.char_map, {_ZERO}, (a, x) -> {_STEP.format("CAST(x.orig AS INT)", "CAST(x.norm AS INT)")}, {_FINISH})
    ELSE aggregate(regexp_extract_all(token.lemma, '(?s).', 0), {_ZERO}, (a, c) -> {_STEP.format("octet_length(c)", "octet_length(c)")}, {_FINISH}) END"""

_ROWS = "pos int, segment string, lemma string, kind string, separator_kind string, script string, language string"


def register(spark: SparkSession, config: TokenizerConfig | None = None) -> None:
    """Registers the functions for one configuration under their names."""
    config = config or TokenizerConfig()

    def scalar(name: str, kernel: op.Kernel, kind: T.DataType) -> None:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                for part in op._pieces(b):
                    yield kernel(core.engine(config), part)
                    pa.default_memory_pool().release_unused()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        spark.udf.register(name, F.arrow_udf(run, kind))

    scalar("tokenize", op._tokens, schema.TOKENS)
    scalar("segment", partial(op._tokens, normalized=False), schema.TOKENS)
    scalar("segment_str", op._strings, schema.STRINGS)
    scalar("normalize_text", op._text, T.StringType())
    scalar("detect_script", lambda e, t: pa.array([None if x is None else e.detect(x) for x in t], pa.string()), T.StringType())
    scalar("detect_language", lambda e, t: pa.array([None if x is None else core.language_for(x, e.detect(x), e.config) for x in t], pa.string()), T.StringType())

    class TokenizeRows:
        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            pos, engine = 0, core.engine(config)
            for parts, script, language in engine.segments(text):
                for segment, (lemma, kind, *_) in zip(parts, engine.facts(parts, script, language), strict=True):
                    yield pos, segment, lemma, *core.KINDS[kind], script, language
                    pos += 1

    spark.udtf.register("tokenize_rows", F.udtf(TokenizeRows, returnType=_ROWS, useArrow=True))
    spark.sql(_ORIGINAL_LENGTHS)
