"""Removal of repeated passages by level-wise doubling.

Lengths double from START words up to WINDOW (7, then 13 for the windows of 13 words
that are asked for; 7, 14, 28, 50 for windows of 50).  At each length only what was
repeated at the one before is extended and compared; a length without candidates leaves
none for the next, and its tasks have nothing to read.

Below WINDOW, a window is stood for by one of its runs of that length: the one with the
smallest hash, which its words alone decide; so about a quarter of all 7-word runs have
to be compared, and a window that repeats has a repeated representative at every length.
Windows over a run that two documents share go on.  At WINDOW words all that are left
are compared.  Nothing longer is needed: a longer repeat is covered by its windows.

A word is removed if a window over it, by the input's words, also starts in a
document with a smaller id.

Each comparison is one shuffle by hash, sorted within the tasks, and read as a
stream: the first row of a run of equal hashes has the smallest id.  A map task
compares what it holds first and sends one row a hash and group of texts, so a
passage in a third of all documents sends a row per 4 MB of text.  Texts move
compressed, by id, once for all levels; positions found go to them by the same key.

Windows compare by 64-bit hashes of 64-bit word hashes.

Edge cases: null and empty texts have no words; texts of under WINDOW words keep all;
rows with a null id neither remove nor lose anything; rows with the same id don't
count as smaller for each other, whether their texts differ or not (texts with one
id are told apart by 31 bits of their hash); an empty table gives an empty result;
only the columns named are looked at.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, WINDOW = 7, 13

_ROWS = "h long, doc_id long, pk long"


def lengths(window: int = WINDOW, start: int = START) -> list[int]:
    """Each twice the one before, or as long as the window: neighbours in a run overlap by as much as is too many."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def representatives(words: np.ndarray, length: int, window: int = WINDOW) -> np.ndarray:
    """Of each window of the words, the smallest hash of its runs of this length."""
    m = common.gram_hashes(words, length)
    width, inside = 1, window - length + 1
    while width < inside:  # minimum over doubled widths
        step = min(width, inside - width)
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        width += step
    return m


class Batch:
    """Windows of a group of texts: document number of each, and whether it lies in one document."""

    def __init__(self, texts: list[bytes], window: int = WINDOW) -> None:
        self.words, self.counts = common.word_hashes(texts)
        self.window, self.first = window, common.starts_of(self.counts)
        many = np.maximum(0, self.counts - window + 1)
        self.doc = np.repeat(np.arange(len(texts)), many)
        #: index of each window's first word among all words, and within its document
        self.local = np.arange(len(self.doc)) - common.starts_of(many)[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        self.at = self.first[self.doc] + self.local if len(self.doc) else self.local

    def values(self, length: int) -> np.ndarray:
        """What stands for each window at a length."""
        return representatives(self.words, length, self.window)[self.at]

    def keyed(self, values: np.ndarray) -> np.ndarray:
        """Values that are equal only within one document."""
        return common.mix(values + common.mix(self.doc.astype(np.uint64) + np.uint64(1)))

    def same(self, values: np.ndarray, doc: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Windows that have the value of one of the windows named by document and place."""
        if not len(doc):
            return np.zeros(len(values), bool)
        begin = np.concatenate([[0], np.cumsum(np.maximum(0, self.counts - self.window + 1))])
        keyed = self.keyed(values)
        return np.isin(keyed, np.unique(keyed[begin[doc] + local]))


def compare(values: np.ndarray, doc: np.ndarray, local: np.ndarray, ids: np.ndarray, tags: np.ndarray, first_too: bool) -> pa.RecordBatch:
    """Rows for the shuffle: the first document of each value; found already: what the group of texts itself shows."""
    if len(doc):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])  # neighbours often share it
        values, doc, local = values[new], doc[new], local[new]
    order = np.lexsort((local, doc, ids[doc], values))
    values, doc, local = values[order], doc[order], local[order]
    if len(doc):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])])
        values, doc, local = values[new], doc[new], local[new]
    n = len(values)
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    one = ids[doc]
    first = one == one[begins][group] if n else np.zeros(0, bool)  # rows of the smallest id
    shared = ~first
    if first_too and n:
        more = np.zeros(len(begins), bool)
        more[group[~first]] = True
        shared = more[group]
    pk = tags[doc] << 32 | local << 1
    send, tell = np.flatnonzero(first), np.flatnonzero(shared)
    spread = common.mix(pk[tell].astype(np.uint64) ^ common.mix(one[tell].astype(np.uint64)))
    h = np.concatenate([values[send], spread]).view(np.int64)
    return pa.record_batch([pa.array(h), pa.array(np.concatenate([one[send], one[tell]])), pa.array(np.concatenate([pk[send], pk[tell] | 1]))], names=["h", "doc_id", "pk"])


def _found(first_too: bool):
    """From rows sorted by hash and id, (doc_id, tag, at) of those found in another (or a smaller) document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # of the last hash: rows not given out that later ones decide on
        smallest: tuple[int, int] | None = None
        for b in batches:
            h, one, pk = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            told = (pk & 1).astype(bool)
            out = [np.stack([one[told], pk[told]])]
            h, one, pk = h[~told], one[~told], pk[~told]
            if len(h):
                if first_too:
                    h, one, pk = np.concatenate([held[0], h]), np.concatenate([held[1], one]), np.concatenate([held[2], pk])
                begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(h))))
                least = one[begins]
                if smallest and smallest[0] == h[0]:
                    least[0] = smallest[1]
                later = one > least[group]
                if first_too:
                    more = np.zeros(len(begins), bool)
                    more[group[later]] = True
                    more[0] |= bool(smallest and smallest[0] == h[0] and not held.size)  # two were seen before
                    out.append(np.stack([one, pk])[:, more[group]])
                    last = slice(begins[-1], None)
                    held = np.zeros((3, 0), np.int64) if more[-1] else np.stack([h[last], one[last], pk[last]])
                else:
                    out.append(np.stack([one, pk])[:, later])
                smallest = (int(h[-1]), int(least[-1]))
            one, pk = np.concatenate(out, 1)
            yield pa.record_batch([pa.array(one), pa.array((pk >> 32).astype(np.int32)), pa.array((pk >> 1 & ((1 << 31) - 1)).astype(np.int32))], names=["doc_id", "tag", "at"])

    return run


def _level(rows: DataFrame, first_too: bool) -> DataFrame:
    """One comparison: rows by hash, and what is found by document."""
    n = common.partitions(rows.sparkSession)
    found = rows.repartition(n, "h").sortWithinPartitions("h", "doc_id").mapInArrow(_found(first_too), "doc_id long, tag int, at int")
    return found.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("at"))


def _first_level(length: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, texts = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_pylist()
            for part in common.groups(texts):
                w = Batch(texts[part], window)
                yield compare(w.values(length), w.doc, w.local, ids[part], tags[part], length < window)

    return run


def _unpack(b: pa.RecordBatch, part: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document number and place of all listed windows (a null list is empty)."""
    lists = b.column("at") if part is None else b.column("at").slice(part.start, part.stop - part.start)
    n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _next_level(before: int, length: int, window: int):
    """Windows whose run of the length before was found, compared at this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            b = b.filter(b.column("at").is_valid())
            ids, tags = b.column("doc_id").to_numpy(), b.column("tag").to_numpy().astype(np.int64)
            texts = [unzip.decompress(z) if z else b"" for z in b.column("z").to_pylist()]
            for part in common.groups(texts):
                w = Batch(texts[part], window)
                pick = w.same(w.values(before), *_unpack(b, part))
                yield compare(w.values(length)[pick], w.doc[pick], w.local[pick], ids[part], tags[part], length < window)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3, write_checksum=False)
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([zip_.compress(t) if t else b"" for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "tag", "z"])


def removed_words(batch: Batch, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each word, whether a window found covers it."""
    pick = batch.same(batch.values(batch.window), *found)
    return common.covered(len(batch.words), batch.at[pick], batch.window)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed, longest_run (of removed words), kept_sha256 and, unless keep_text is false, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 33).cast("int").alias("tag"), common.as_bytes(text_col))
    texts = rows.mapInArrow(_pack, "doc_id long, tag int, z binary")
    key, levels = ["doc_id", "tag"], lengths(window, start)
    found = _level(rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_first_level(levels[0], window), _ROWS), levels[0] < window)
    for before, length in pairwise(levels):
        # an outer join, so that the shuffle of the texts is the same for all levels and below, and done once
        held = texts.join(found.hint("merge"), key, "left").select(*key, "z", "at")
        found = _level(held.mapInArrow(_next_level(before, length, window), _ROWS), length < window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for part in common.groups(sizes := b.column("z").to_pylist(), 1 << 20):
                texts = [unzip.decompress(z) if z else b"" for z in sizes[part]]
                w = Batch(texts, window)
                gone = removed_words(w, _unpack(b, part))
                kept, removed, longest = [], [], []
                for text, s, n in zip(texts, w.first, w.counts, strict=True):
                    drop = gone[s : s + n]
                    words = text.split()
                    removed.append(int(drop.sum()))
                    runs = np.flatnonzero(np.diff(drop, prepend=False, append=False)) if removed[-1] else np.zeros(0, int)
                    longest.append(int((runs[1::2] - runs[::2]).max(initial=0)))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~drop)] if removed[-1] else words))
                cols = [b.column("doc_id").slice(part.start, part.stop - part.start), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(longest, pa.int64()), pa.array([common.digest_hex(k) for k in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "longest_run", "kept_sha256"]
                if keep_text:
                    cols, names = [*cols, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.record_batch(cols, names=names)

    schema = "doc_id long, n_words long, n_removed long, longest_run long, kept_sha256 string" + ", kept string" * keep_text
    return texts.join(found.hint("merge"), key, "left").select(*key, "z", "at").mapInArrow(finish, schema)
