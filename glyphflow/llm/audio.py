"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording's short-time spectra are folded into twelve pitch classes a frame,
smoothed over time and scaled to one.  Sixteen filters, each a difference of sums
over rectangles of the pitch-class image, are read off its integral image at every
frame; each answer is quantised to four levels, written as two bits of Gray code,
and the sixteen make one packed 32-bit integer a frame.

Two recordings are aligned by the histogram of the offsets at which the first or the
last KEY bits of their integers agree; at every offset with VOTES agreements all bits
are compared over the overlap.  A match has at most MAX_ERROR of the bits wrong over MIN_OVERLAP frames.

Search: the queries go out in blocks of BLOCK recordings (about 1 MB), each with an
index from key bits to places; all fingerprints, kept once in the shared folder,
are read against each block, and each block's matches are a table of their own part.
There is no cap on candidates or matches.

Scale: one pass over the media, one pass over the fingerprints a block of queries,
no shuffle.  The driver holds one block of queries at a time.

Edge cases: null or empty media, media shorter than one filter and silence have no
integers and match nothing; rows with a null id are no queries and no matches;
repeated rows match like others (a row isn't matched with its own id); an empty
table gives an empty result.  decode makes samples from one value of the column;
the default reads WAV with 16-bit samples, and what isn't WAV counts as no media.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, FRAME, HOP = 4096, 1024, 256
LOWEST = 110.0
SPAN = 16
KEY, VOTES, MIN_OVERLAP, MAX_ERROR = 16, 2, 24, 0.2
_LOW = np.uint32((1 << KEY) - 1)
BLOCK = 4096
_WIDE = 1 << 32

_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
_SMOOTH /= _SMOOTH.sum()
#: kind, first pitch class, pitch classes, frames of each filter: every kind at four heights and widths
_FILTERS = [(kind, (3 * k + kind) % 9, 3 + k, 4 * (k + 1)) for k in range(4) for kind in range(4)]
_LEVELS = np.array([-0.25, 0.0, 0.25])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), 12))
    use = np.flatnonzero((freq >= LOWEST) & (freq < RATE / 2))
    out[use, np.round(12 * np.log2(freq[use] / LOWEST)).astype(int) % 12] = 1
    return out


_FOLD, _WINDOW = _fold(), np.hanning(FRAME)


def wav_samples(data: bytes) -> np.ndarray:
    """Mono samples at RATE of a WAV with 16-bit samples."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float64)
            x = x[: len(x) // f.getnchannels() * f.getnchannels()].reshape(-1, f.getnchannels()).mean(1)
            rate = f.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x) * RATE // rate) * rate / RATE, np.arange(len(x)), x)
    return x


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 pitch classes, smoothed, each frame scaled to a sum of one (silence: zeros)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    out = []
    for lo in range(0, n, 4096):
        count = min(4096, n - lo)
        view = np.lib.stride_tricks.sliding_window_view(samples[lo * HOP : (lo + count - 1) * HOP + FRAME], FRAME)[::HOP]
        out.append(np.abs(np.fft.rfft(view * _WINDOW)) ** 2 @ _FOLD)
    energy = np.concatenate(out)
    padded = np.pad(energy, ((2, 2), (0, 0)), "edge")
    smooth = sum(w * padded[k : k + n] for k, w in enumerate(_SMOOTH))
    total = smooth.sum(1, keepdims=True)
    return np.divide(smooth, total, out=np.zeros_like(smooth), where=total > 1e-9)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame that a filter's SPAN frames begin with."""
    n = len(image) - SPAN + 1
    if n < 1 or not image.any():
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    column = np.ascontiguousarray(total.T)

    def area(a: int, b: int, p: int, q: int) -> np.ndarray:
        return column[q, b : b + n] - column[q, a : a + n] - column[p, b : b + n] + column[p, a : a + n]

    out = np.zeros(n, np.uint32)
    for kind, low, height, width in _FILTERS:
        high, mid, half, third = low + height, low + (height + 1) // 2, width // 2, width // 3 or 1
        high = min(high, 12)
        if kind == 0:  # earlier against later
            a, b = area(0, half, low, high), area(half, width, low, high)
        elif kind == 1:  # lower against higher
            a, b = area(0, width, low, mid), area(0, width, mid, high)
        elif kind == 2:  # corner against corner
            a, b = area(0, half, low, mid) + area(half, width, mid, high), area(half, width, low, mid) + area(0, half, mid, high)
        else:  # middle against both ends
            a = area(third, width - third, low, high)
            b = area(0, third, low, high) + area(width - third, width, low, high)
        out = out << np.uint32(2) | _GRAY[np.searchsorted(_LEVELS, np.log((0.05 + a) / (0.05 + b)))]
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = wav_samples) -> DataFrame:
    """id, ints array<int> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ints = [packed(chroma(decode(x))) if x else np.zeros(0, np.uint32) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([x.view(np.int32) for x in ints], pa.list_(pa.int32()))], names=["id", "ints"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col)).mapInArrow(run, "id long, ints array<int>")


class Index:
    """Places of the two halves (KEY bits each) of the integers of a block of queries."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]) -> None:
        self.ids = np.array(ids, np.int64)
        self.ints = np.concatenate([*prints, np.zeros(0, np.uint32)])
        self.length = np.array([len(p) for p in prints], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        who = np.repeat(np.arange(len(prints)), self.length)
        at = np.arange(len(self.ints)) - self.begin[who] if len(who) else np.zeros(0, np.int64)
        key = np.concatenate([self.ints >> np.uint32(KEY), (self.ints & _LOW) + np.uint32(1 << KEY)])
        order = np.argsort(key, kind="stable")
        # who and where in one number: adding a frame gives the cell of (who, offset)
        self.code = np.tile(who * _WIDE + (_WIDE >> 1) - at, 2)[order]
        self.first = np.searchsorted(key[order], np.arange((2 << KEY) + 1))

    def matches(self, ints: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(query number, offset, wrong bits, frames compared) of the queries that match."""
        key = np.concatenate([ints >> np.uint32(KEY), (ints & _LOW) + np.uint32(1 << KEY)])
        lo = self.first[key]
        many = self.first[key + np.uint32(1)] - lo
        end = many.cumsum()
        if not end[-1:].any():
            return []
        cell = self.code[np.arange(end[-1]) + np.repeat(lo - end + many, many)]
        cell += np.repeat(np.tile(np.arange(len(ints)), 2), many)
        cell.sort()
        same = cell[VOTES - 1 :] == cell[: len(cell) - VOTES + 1]
        cell = cell[: len(same)][same]
        cell = cell[np.diff(cell, prepend=-1) != 0]
        who, shift = cell // _WIDE, cell % _WIDE - (_WIDE >> 1)
        begin, end = np.maximum(0, shift), np.minimum(len(ints), self.length[who] + shift)
        n = end - begin
        long = n >= MIN_OVERLAP
        who, shift, begin, n = who[long], shift[long], begin[long], n[long]
        if not len(who):
            return []
        row = np.repeat(np.arange(len(who)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        mine = begin[row] + step
        wrong = np.add.reduceat(np.bitwise_count(ints[mine] ^ self.ints[self.begin[who][row] + mine - shift[row]]).astype(np.int64), np.cumsum(n) - n)
        good = np.flatnonzero(wrong <= MAX_ERROR * 32 * n)
        best: dict[int, tuple[int, int, int]] = {}
        for q, s, w, k in zip(who[good].tolist(), shift[good].tolist(), wrong[good].tolist(), n[good].tolist(), strict=True):
            if q not in best or w * best[q][2] < best[q][1] * k:
                best[q] = s, w, k
        return [(q, *v) for q, v in sorted(best.items())]


_FOUND = "query_id long, match_id long, frame_offset int, wrong_bits int, n_frames int"


def _against(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = block.value
        for b in batches:
            for part in range(0, b.num_rows, 500):
                s = b.slice(part, 500)
                rows = []
                for i, ints in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    if i is not None and ints:
                        got = index.matches(np.array(ints, np.int32).view(np.uint32))
                        rows += [(int(index.ids[q]), i, *rest) for q, *rest in got if index.ids[q] != i]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "match_id", "frame_offset", "wrong_bits", "n_frames"])

    return run


def search(prints: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """All matches of queries (id, ints) among prints (id, ints), without those of the same id.

    Each block's matches are appended to a table in the shared folder and its index is given
    up, so neither the driver, the executors nor the plan grow with the number of blocks.
    """
    spark = prints.sparkSession
    at = common.scratch(spark, "matches")
    ids, ints, sent = [], [], 0

    def send() -> None:
        index = spark.sparkContext.broadcast(Index(ids, ints))
        prints.mapInArrow(_against(index), _FOUND).write.mode("append").parquet(at)
        index.destroy()

    for row in queries.filter(F.col("id").isNotNull() & (F.size("ints") > 0)).toLocalIterator():
        ids.append(row[0])
        ints.append(np.array(row[1], np.int32).view(np.uint32))
        if len(ids) == block:
            send()
            ids, ints, sent = [], [], sent + 1
    if ids or not sent:
        send()
    return spark.read.schema(_FOUND).parquet(at)


NOTES, NOTE = 64, 256


def render(vector: list[float]) -> np.ndarray:
    """A recording for a table without media: each number of the vector becomes a note, higher for higher values."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    scale = math.sqrt(len(v)) / (np.linalg.norm(v) or 1.0)
    step = 2 * np.array([math.floor(6 * 0.5 * (1 + math.erf(x * scale / math.sqrt(2)))) for x in v])
    freq = np.repeat(220.0 * 2.0 ** (step / 12), NOTE)
    return np.sin(2 * np.pi * np.cumsum(freq) / RATE)


def self_search(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = wav_samples, every: int = 20) -> DataFrame:
    """Every row against the rows whose id is divisible by every: id, n_ints and ints_sha256 (of the
    decimal integers, comma-joined), and the queries it matches, a row each (nulls: none)."""
    prints = common.cut(fingerprints(media, id_col, media_col, decode))
    found = search(prints, prints.filter(F.col("id") % every == 0)).distinct()
    digest = F.sha2(F.array_join(F.col("ints").cast("array<string>"), ","), 256).alias("ints_sha256")
    rows = prints.select("id", F.size("ints").cast("long").alias("n_ints"), digest)
    return rows.join(found.withColumnRenamed("match_id", "id"), "id", "left")
