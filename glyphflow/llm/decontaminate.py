"""Benchmark decontamination by a prefix-filtered set join.

Every item is turned into its windows of thirteen consecutive words; an item of
fewer words, but not none, is one window.  Words are ordered by rarity over the
whole benchmark.  A match has to contain the whole window, so the necessary prefix
of a window is one word: its rarest.  Document words are joined with the windows on
that word; the positional bound places the window around it, the length bound drops
what would reach beyond the document, and what is left is verified word by word over
as many words as the window has.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased.

Rarity is counted in RANKS cells by the words' hashes, so the table of counts has a
fixed size (1 MB) whatever the benchmark; words that share a cell share a count, which
changes the order and no result, as any one order of all words will do.

Scale: windows are made where the items are read.  Up to BLOCK windows of LARGEST
bytes together, both counted before, go out to the tasks as one sorted index, and the
join is a map over the documents without a shuffle.  Beyond that it is a join of
tables on the prefix word: documents send the words around each word that may be a
prefix (a filter of a fixed 2 MB tells), windows lie beside them, built-in functions
verify, and the hits go back to their documents.  A prefix word in a third of all
documents meets few windows; AQE splits it, as neither side is grouped by it.

Edge cases: null and empty texts have no words and no hits; items without words
are never found; repeated items count once by item id; a null item id is not
counted as an item, though its words are hit; repeated rows and an empty table
on either side are as usual; only the columns named are looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Windows, and bytes of their words, that are sent to all tasks at most; more are joined as a table.
BLOCK, LARGEST = 500_000, 64 << 20
RANKS = 1 << 18
#: Bits of the filter of prefix words.
FILTER = 1 << 24

_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False
_BETWEEN[0x41:0x5B] = False  # they are folded to lower case
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_LOWER = bytes(_FOLD.tolist())


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return common.word_hashes(texts, _BETWEEN, _FOLD)


class Words:
    """Words of some texts: hashes, counts by text, and the folded bytes of any run of them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.hashes, self.begin, self.end = common.word_spans(texts, _BETWEEN, _FOLD)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.counts = np.diff(np.searchsorted(self.begin, np.concatenate([[0], np.cumsum(lengths)])))
        self.first, self.last = common.starts_of(self.counts), np.cumsum(self.counts)
        self._bytes = (b"\n".join(texts) + b"\n").translate(_LOWER)

    def run(self, start: int, n: int) -> bytes:
        """n words, joined by single spaces."""
        return b" ".join([self._bytes[a:b] for a, b in zip(self.begin[start : start + n].tolist(), self.end[start : start + n].tolist(), strict=True)])


def _cell(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(46)).astype(np.int64)


def rarity(benchmark: DataFrame, text_col: str) -> np.ndarray:
    """How often words of each of RANKS cells stand in the benchmark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANKS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in common.groups(texts):
                total += np.bincount(_cell(words_of(texts[part])[0]), minlength=RANKS)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    # RANKS rows at most
    rows = benchmark.select(common.as_bytes(text_col)).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(RANKS, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


_WINDOWS = "item string, n int, shift int, prefix long, gram long, words binary"


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """All windows of all items, each once an item: its words, their hash, the rarest word's hash and place."""
    ranks = benchmark.sparkSession.sparkContext.broadcast(rarity(benchmark, text_col))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = Words([text])
                n, h = min(size, len(w.hashes)), w.hashes
                if not n:
                    continue
                grams = common.gram_hashes(h, n).view(np.int64)
                order = np.lexsort((h, ranks.value[_cell(h)]))  # rarest first, ties by hash
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h))
                for lo in range(0, len(grams), 4096):
                    hi = min(lo + 4096, len(grams))
                    shift = np.lib.stride_tricks.sliding_window_view(place, n)[lo:hi].argmin(1)
                    prefix = h[np.arange(lo, hi) + shift].view(np.int64)
                    words = [w.run(k, n) for k in range(lo, hi)]
                    yield pa.record_batch([pa.array([name] * (hi - lo), pa.string()), pa.array([n] * (hi - lo), pa.int32()), pa.array(shift, pa.int32()), pa.array(prefix), pa.array(grams[lo:hi]), pa.array(words, pa.binary())], names=["item", "n", "shift", "prefix", "gram", "words"])

    return benchmark.select(F.col(item_col).cast("string"), common.as_bytes(text_col)).mapInArrow(make, _WINDOWS).distinct()


class Index:
    """Windows grouped by size and sorted by their rarest word."""

    def __init__(self, rows: list[tuple]) -> None:
        self.names = sorted({r[0] for r in rows if r[0] is not None})
        number = {name: k for k, name in enumerate(self.names)}
        by_size: dict[int, dict[tuple[int, int, int, bytes], set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, n, shift, prefix, gram, words in rows:
            by_size[n][prefix & 0xFFFFFFFFFFFFFFFF, shift, gram & 0xFFFFFFFFFFFFFFFF, bytes(words)].add(number.get(name, -1))
        self.sizes = {}
        #: whether some rarest word begins with these bits: most document words end here
        self.maybe = np.zeros(1 << 20, bool)
        for n, found in by_size.items():
            keys = sorted(found)
            self.sizes[n] = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.int64), np.array([k[2] for k in keys], np.uint64), [k[3] for k in keys], [sorted(found[k]) for k in keys]
            self.maybe[self.sizes[n][0] >> np.uint64(44)] = True

    def find(self, w: Words) -> tuple[np.ndarray, list[set[int]], np.ndarray]:
        """Which words are hit; of each text, numbers of the items found and whether a window of WINDOW words is."""
        hit, items, full = np.zeros(len(w.hashes), bool), [set() for _ in w.counts], np.zeros(len(w.counts), bool)
        likely = np.flatnonzero(self.maybe[w.hashes >> np.uint64(44)])
        if not len(likely):
            return hit, items, full
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        for n, (rare, shift, gram, words, owners) in self.sizes.items():
            lo, hi = np.searchsorted(rare, w.hashes[likely], "left"), np.searchsorted(rare, w.hashes[likely], "right")
            at, lo, many = likely[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            grams = common.gram_hashes(w.hashes, n)
            for part in np.array_split(np.arange(len(at)), max(1, int(many.sum()) // 2_000_000)):
                p, m, l = at[part], many[part], lo[part]
                where = np.repeat(p, m)
                entry = np.arange(len(where)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(l, m)
                start = where - shift[entry]
                d = doc[where]
                ok = (start >= w.first[d]) & (start + n <= w.last[d])  # positional and length bounds
                start, entry, d = start[ok], entry[ok], d[ok]
                same = np.flatnonzero(grams[start] == gram[entry])  # what differs in its hash differs
                same = np.array([k for k in same.tolist() if w.run(int(start[k]), n) == words[entry[k]]], np.int64)  # word by word
                for k in same.tolist():
                    items[d[k]].update(owners[entry[k]])
                hit |= common.covered(len(w.hashes), np.unique(start[same]), n)
                full[d[same]] |= n == WINDOW
        return hit, items, full


def _index(wins: DataFrame) -> Index | None:
    """The index of all windows, or None if they are too many to be sent to all tasks."""
    size = wins.agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + 40).alias("bytes")).first()
    if size["n"] > BLOCK or (size["bytes"] or 0) > LARGEST:
        return None
    return Index([tuple(r) for r in wins.toLocalIterator()])


def _counted(index, batch: pa.RecordBatch, texts: list[bytes], make: Callable) -> Iterator[pa.RecordBatch]:
    for part in common.groups(texts):
        w = Words(texts[part])
        hit, items, full = index.value.find(w)
        sums = np.concatenate([[0], np.cumsum(hit)])
        yield make(batch.slice(part.start, part.stop - part.start), w, sums[w.last] - sums[w.first], items, full)


def _around(bits) -> Callable:
    """row (hash of the text), prefix, at (of the prefix word in the run), start (of the run in the text), run (words around it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in common.groups(texts):
                w, rows = Words(texts[part]), b.column(0).slice(part.start, part.stop - part.start).to_numpy()
                at = np.flatnonzero(bits.value[(w.hashes >> np.uint64(40)).astype(np.int64)])
                doc = np.searchsorted(w.last, at, "right")
                begin, end = np.maximum(w.first[doc], at - WINDOW + 1), np.minimum(w.last[doc], at + WINDOW)
                for lo in range(0, len(at), 8192):
                    s = slice(lo, lo + 8192)
                    runs = [w.run(x, y - x) for x, y in zip(begin[s].tolist(), end[s].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(rows[doc[s]]), pa.array(w.hashes[at[s]].view(np.int64)), pa.array((at - begin)[s], pa.int32()), pa.array((begin - w.first[doc])[s], pa.int32()), pa.array(runs, pa.binary())], names=["row", "prefix", "at", "start", "run"])

    return run


def _joined(docs: DataFrame, text_col: str, wins: DataFrame) -> DataFrame:
    """row (hash of a text), n_hit, items, full (whether a whole WINDOW is hit) of the texts with hits, by a join on the prefix word."""
    spark = docs.sparkSession
    cells = wins.select(F.shiftrightunsigned("prefix", 40).cast("int").alias("c")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER, bool)
        for b in batches:
            seen[b.column(0).to_numpy()] = True
        yield pa.record_batch([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["bits"])

    bits = np.zeros(FILTER, bool)
    for r in cells.repartition(4).mapInArrow(packed, "bits binary").toLocalIterator():  # four rows of 2 MB
        bits |= np.unpackbits(np.frombuffer(r[0], np.uint8)).astype(bool)
    texts = docs.select(common.as_bytes(text_col)).withColumn("row", F.xxhash64("text")).select("row", "text")
    around = texts.mapInArrow(_around(spark.sparkContext.broadcast(bits)), "row long, prefix long, at int, start int, run binary")
    run = F.split(F.col("run").cast("string"), " ")
    from_ = F.col("at") - F.col("shift")
    both = around.join(wins.select("item", "n", "shift", "prefix", F.col("words").cast("string").alias("words")), "prefix")
    both = both.withColumn("r", run).filter((from_ >= 0) & (from_ + F.col("n") <= F.size("r")))
    found = both.filter(F.array_join(F.slice("r", from_ + 1, F.col("n")), " ") == F.col("words")).select("row", (F.col("start") + from_).alias("s"), "n", "item").distinct()
    one = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"), (F.max("n") >= WINDOW).alias("full"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    union = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])
    return one.select("row", union.cast("long").alias("n_hit"), "items", "full")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items array<string> (sorted ids of the items found) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    wins = common.cut(windows(benchmark, item_col, item_text))
    index = _index(wins)
    if index is not None:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(b: pa.RecordBatch, w: Words, n_hit: np.ndarray, items: list[set[int]], _: np.ndarray) -> pa.RecordBatch:
            names = pa.array([[sent.value.names[i] for i in sorted(x) if i >= 0] for x in items], pa.list_(pa.string()))
            return pa.record_batch([b.column(0), pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), names], names=["doc_id", "n_words", "n_hit", "items"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _counted(sent, b, b.column(1).to_pylist(), make)

        return docs.select(F.col(id_col).alias("doc_id"), common.as_bytes(text_col)).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for part in common.groups(texts):
                s = b.slice(part.start, part.stop - part.start)
                yield pa.record_batch([s.column(0), s.column(1), pa.array(words_of(texts[part])[1], pa.int64())], names=["doc_id", "row", "n_words"])

    rows = docs.select(F.col(id_col).alias("doc_id"), common.as_bytes(text_col)).withColumn("row", F.xxhash64("text")).select("doc_id", "row", "text").mapInArrow(count, f"doc_id {kind}, row long, n_words long")
    found = _joined(docs, text_col, wins)
    return rows.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_benchmark(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those that hold a whole window of WINDOW words
    of an item, however long they are, or of which a twentieth is made of shorter items."""
    wins = common.cut(windows(benchmark, item_col, item_text))
    index = _index(wins)
    if index is None:
        found = _joined(docs, text_col, wins).select(F.col("row").alias("_text_hash"), F.col("n_hit").alias("_words_hit"), F.col("full").alias("_whole_window"))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        n_words = F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
        rows = docs.withColumns({"_text_hash": F.xxhash64(text.cast("binary")), "_words": n_words}).join(found, "_text_hash", "left")
        return rows.filter(F.col("_words_hit").isNull() | ~(F.col("_whole_window") | contaminated(F.col("_words_hit"), F.col("_words")))).select(*docs.columns)
    sent, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)

    def keep(b: pa.RecordBatch, w: Words, n_hit: np.ndarray, _: list[set[int]], full: np.ndarray) -> pa.RecordBatch:
        return b.filter(pa.array(~(full | contaminated(n_hit, w.counts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _counted(sent, b, [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], keep)

    return docs.mapInArrow(run, docs.schema)
