"""Token counts through a digest cache.

The digest of a text's normalised content and the digest of the tokenizer's
version key a table of stored counts.  Texts are joined to it by digest; each
distinct text that it lacks is encoded once, its count is appended to the table,
and every document then takes its count from there.

The only normalisation that leaves every count as it is reads a null as the
empty text, so that is the one applied.

Scale: digests (32 bytes a row) are aggregated and joined, not texts; whole
texts move once, to the task of the document that represents its digest.  A
digest shared by a third of all rows is one row after the map-side aggregation,
and the join of the counts back is a sort-merge join whose skew AQE splits.  A
lost executor costs its tasks; the append commits as a whole or not at all, and
readers take one count a digest, so a repeated append does no harm.

Edge cases: null and empty texts count 0 tokens; repeated rows give repeated
rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Segments, and characters of them, whose counts one Python worker remembers at most.
MEMO, MEMO_SIZE = 400_000, 16 << 20

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version_digest(model: str) -> str:
    """What the counts depend on beside the text: the bytes of the vocabulary file."""
    return hashlib.sha256(Path(model).read_bytes()).hexdigest()[:16]


class PieceCounter:
    """Counts the ids of a sentencepiece model or of a tokenizers file.

    With sentencepiece, no piece has the mark of a space after another character
    and none has a line feed (both are checked; otherwise texts are encoded
    whole), so no piece crosses the start of a run of spaces or a line feed, and
    a text's count is the sum over such segments.  Counts of segments are
    remembered; the library encodes those not seen before.
    """

    PARTS = re.compile(r"\n| *[^ \n]+| +")

    def __init__(self, model: str) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.split = False
        if model.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(model)
            tok.no_truncation()
            tok.no_padding()
            self.lengths = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
            return
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        whole = all("▁" not in p.lstrip("▁") and "\n" not in p for p in pieces)
        # one mark is put before a text, spaces stay as they are, a line feed is one byte piece
        self.split = whole and [sp.encode(x, out_type=str) for x in ("", "\n", "  \n", "a  ")] == [[], ["▁", "<0x0A>"], ["▁▁▁", "<0x0A>"], ["▁a", "▁▁"]]

    def _learn(self, parts: set[str]) -> None:
        """A segment with k spaces in front is the text with k - 1, after the mark that the
        library puts before a text; one without is encoded after a line feed, less both ids."""
        todo = list(parts)
        self.held += sum(map(len, todo))
        texts = [p[1:] if p[0] == " " else "\n" + p for p in todo]
        for p, t, n in zip(todo, texts, self.lengths(texts), strict=True):
            self.known[p] = n - 2 if p[0] != " " else n if t else 1

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.lengths(texts)
        out, known = [], self.known
        for text in texts:
            if not text:
                out.append(0)
                continue
            parts = self.PARTS.findall(" " + text.replace("▁", " "))
            try:
                out.append(sum(map(known.__getitem__, parts)))
            except KeyError:
                if len(known) > MEMO or self.held > MEMO_SIZE:
                    known.clear()
                    self.held = 0
                known["\n"] = 1
                self._learn({p for p in parts if p not in known})
                out.append(sum(map(known.__getitem__, parts)))
        return out


_counters: dict[str, PieceCounter] = {}


def _counter(model: str) -> PieceCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(model)
    return _counters[model]


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row a digest."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, cached: DataFrame, model: str, version: str) -> DataFrame:
    """(digest, version, n_tokens) of every distinct text that is not cached."""
    keyed = docs.select("doc_id", "digest")
    # A null id compares with nothing, so it is set apart from all real ones for the join.
    null = F.col("doc_id").isNull()
    key = F.struct(null.alias("none"), F.when(null, F.lit(0)).otherwise(F.col("doc_id")).alias("id"))
    first = keyed.groupBy("digest").agg(F.min(key).alias("key"))
    misses = first.join(cached, "digest", "left_anti")
    texts = docs.withColumn("key", key).select("key", "digest", "text").join(misses.hint("merge"), ["key", "digest"], "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = _counter(model), set()
        for b in batches:
            digests, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            # repeated rows follow each other: the merge join has sorted them by key and digest
            new = dict(zip(digests, texts, strict=True))
            new = {d: t for d, t in new.items() if d not in last}
            last = set(digests[-1:]) | set(new)
            n = count(list(new.values()))
            yield pa.record_batch({"digest": pa.array(new, pa.binary()), "version": pa.array([version] * len(n), pa.string()), "n_tokens": pa.array(n, pa.int64())})

    return texts.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; new counts are appended to the table at cache."""
    spark = docs.sparkSession
    version = version_digest(model)
    keyed = with_digest(docs, id_col, text_col)
    encode_misses(keyed, read_cache(spark, cache, version), model, version).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", F.xxhash64("digest").alias("h"))
    # the counts are grouped by digest; with a second key both sides are shuffled for the join, and AQE can split a hot digest
    return rows.join(counts.withColumn("h", F.xxhash64("digest")), ["digest", "h"], "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
