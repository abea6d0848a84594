"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks which cover the whole of it.
A byte enters as a learned vector and one more channel, which tells whether the
byte's word repeats the word before.  Learned filters slide over each chunk and
are max-pooled in it; a text's pooled vectors are averaged and their maximum
taken over all its chunks, and a logistic unit makes one probability of both.

Training: at most SAMPLE labelled rows of each class, those whose ids have the
smallest hashes, with all of their chunks as in scoring, on the driver, PIECE
chunks at a time; only rows outside the held-out fold.  The class shares of all training
labels correct the intercept, as the sample is balanced.  Same rows, same model.

Scale: scoring is a map without a shuffle; a worker holds PIECE chunks and the pooled
vectors (128 bytes a chunk) of a few hundred kB of text, or of one longer text, at once.
The sample's ids are broadcast (2 * SAMPLE rows at most), so only the sample's texts are
shuffled and collected for training, one an id and label.

Edge cases: null and empty texts have no chunk, their pooled vectors are zeros and
the intercept makes their score; without labels of both classes every score is
the share of label 1 (0.5 without labels); other values of the label than 0 and 1
and null ids among the labels are not learned from; a row's fold with a null id
is that of the empty text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 1000
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Chunks that are looked at at once.
PIECE = 1024
CHUNK, STEP = 256, 240
WIDTH, STRIDE, DIM, FILTERS = 8, 4, 7, 32
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
STEPS, BATCH, RATE = 260, 32, 4e-3
#: Bytes of text whose chunks are held at once.
GROUP = 1 << 18
THRESHOLD = 0.7


def repeats(texts: list[bytes]) -> np.ndarray:
    """Of each byte of the texts joined by line feeds, whether its word is the one before it in the same text again."""
    out = np.zeros(sum(map(len, texts)) + len(texts), np.int8)
    begin = 0
    for part in common.groups(texts, common.CHUNK):
        buf = b"\n".join(texts[part]) + b"\n"
        first = begin + common.starts_of(np.array([len(t) + 1 for t in texts[part]]))
        at, last = 0, None
        while at < len(buf):  # a long text in pieces that end at white space
            to = min(len(buf), at + common.CHUNK)
            if to < len(buf) and (m := _SPACE.search(buf, to)):
                to = m.end()
            elif to < len(buf):
                to = len(buf)
            hashes, starts, ends = common.word_spans([buf[at:to]])
            if len(hashes):
                again = np.concatenate([[last is not None and hashes[0] == last], hashes[1:] == hashes[:-1]])
                starts, ends = starts + begin + at, ends + begin + at
                text = np.searchsorted(first, starts, "right")
                again[1:] &= text[1:] == text[:-1]
                step = np.zeros(to - at + 1, np.int8)
                step[starts[again] - begin - at] += 1
                step[ends[again] - begin - at] -= 1
                out[begin + at : begin + to] = np.cumsum(step[:-1], dtype=np.int8)
                last = hashes[-1] if len(texts[part]) == 1 else None
            at = to
        begin += len(buf)
    return out


class Chunks:
    """The chunks of some texts, made in pieces: whole texts are held as two bytes a byte."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.counts = np.where(self.lengths > 0, np.maximum(0, -(-(self.lengths - CHUNK) // STEP)) + 1, 0)
        self._begin, self._first = common.starts_of(self.lengths + 1), common.starts_of(self.counts)
        self._data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(CHUNK), np.uint8)
        self._again = np.concatenate([repeats(texts), np.zeros(CHUNK, np.int8)])

    def __len__(self) -> int:
        return int(self.counts.sum())

    def piece(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (0 beyond the text) and repeat channel of the chunks lo to hi."""
        k = np.arange(lo, min(hi, len(self)))
        doc = np.searchsorted(np.cumsum(self.counts), k, "right")
        at = (k - self._first[doc]) * STEP
        inside = (at[:, None] + np.arange(CHUNK)) < self.lengths[doc][:, None]
        where = np.minimum((self._begin[doc] + at)[:, None] + np.arange(CHUNK), len(self._data) - 1)
        return np.where(inside, self._data[where], 0), np.where(inside, self._again[where], 0).astype(np.uint8)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and repeat channel of all chunks of all texts, and how many each text has."""
    c = Chunks(texts)
    pieces = [c.piece(i, i + PIECE) for i in range(0, len(c), PIECE)] or [(np.zeros((0, CHUNK), np.uint8),) * 2]
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), c.counts


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * (DIM + 1) x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    intercept: float

    def inputs(self, data: np.ndarray, again: np.ndarray) -> np.ndarray:
        x = np.empty((*data.shape, DIM + 1), np.float32)
        x[..., :DIM] = self.embed[data]
        x[..., DIM] = again
        n, _, c = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, POSITIONS, WIDTH * c), (s[0], s[1] * STRIDE, s[2]))
        return np.ascontiguousarray(view).reshape(n * POSITIONS, WIDTH * c)

    def pooled(self, data: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Max over positions of the rectified filters, for each chunk."""
        if not len(data):
            return np.zeros((0, FILTERS), np.float32)
        act = (self.inputs(data, again) @ self.filters).reshape(len(data), POSITIONS, FILTERS).max(1)
        return np.maximum(act + self.bias, 0)

    def features(self, pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(counts), 2 * FILTERS), np.float32)
        full = np.flatnonzero(counts)
        if len(full):
            at = common.starts_of(counts)[full]
            out[full, :FILTERS] = np.add.reduceat(pooled, at) / counts[full, None]
            out[full, FILTERS:] = np.maximum.reduceat(pooled, at)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in common.groups(texts, GROUP):
            c = Chunks(texts[part])
            pooled = [self.pooled(*c.piece(i, i + PIECE)) for i in range(0, len(c), PIECE)]
            logits = self.features(np.concatenate(pooled) if pooled else np.zeros((0, FILTERS), np.float32), c.counts) @ self.out + self.intercept
            out.append(1 / (1 + np.exp(-logits.astype(np.float64))))
        return np.concatenate(out)


def constant(share: float) -> Network:
    """The network that gives every text the same score."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros((256, DIM), np.float32), np.zeros((WIDTH * (DIM + 1), FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(share / (1 - share))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float, seed: int = 7) -> Network:
    """Adam on the logistic loss; rows: (label, bytes and repeat channel of all chunks)."""
    labels = np.array([r[0] for r in rows])
    if len(set(labels.tolist())) < 2:
        return constant(prior)
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, (WIDTH * (DIM + 1)) ** -0.5, (WIDTH * (DIM + 1), FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    names = ("embed", "filters", "bias", "out", "intercept")
    moments = {k: [0.0, 0.0] for k in names}
    pools = [np.flatnonzero(labels == k) for k in (0, 1)]
    for t in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(p, BATCH // 2) for p in pools])
        y = labels[pick]
        data, again = np.concatenate([rows[i][1] for i in pick]), np.concatenate([rows[i][2] for i in pick])
        counts = np.array([len(rows[i][1]) for i in pick])
        pieces = [slice(i, i + PIECE) for i in range(0, len(data), PIECE)]
        best, raw = [], []
        for k in pieces:
            act = (net.inputs(data[k], again[k]) @ net.filters).reshape(-1, POSITIONS, FILTERS)
            best.append(act.argmax(1))  # chunk x filter
            raw.append(np.take_along_axis(act, best[-1][:, None], 1)[:, 0] + net.bias)
        raw = np.concatenate(raw)
        pooled = np.maximum(raw, 0)
        feats = net.features(pooled, counts)
        p = 1 / (1 + np.exp(-(feats @ net.out + net.intercept)))
        d = ((p - y) / len(y)).astype(np.float32)
        grad = {"out": feats.T @ d + 1e-4 * net.out, "intercept": float(d.sum())}
        doc = np.repeat(np.arange(len(pick)), counts)
        top = pooled == feats[doc, FILTERS:]
        back = d[doc, None] * (net.out[:FILTERS] / counts[doc, None] + top * net.out[FILTERS:])
        back = (back * (raw > 0)).astype(np.float32)
        grad["bias"] = back.sum(0)
        grad["filters"], grad["embed"] = np.zeros_like(net.filters), np.zeros_like(net.embed)
        for k, top_at in zip(pieces, best, strict=True):
            where = top_at[:, :, None] * STRIDE + np.arange(WIDTH)
            byte = np.take_along_axis(data[k][:, None, :], where, 2)
            flag = np.take_along_axis(again[k][:, None, :], where, 2)
            seen = np.concatenate([net.embed[byte], flag[..., None].astype(np.float32)], 3).reshape(*top_at.shape, -1)  # chunk x filter x inputs
            grad["filters"] += np.einsum("cfi,cf->if", seen, back[k])
            to = np.einsum("cf,if->cfi", back[k], net.filters).reshape(-1, FILTERS, WIDTH, DIM + 1)[..., :DIM]
            grad["embed"] += np.stack([np.bincount(byte.ravel(), to[..., j].ravel(), 256) for j in range(DIM)], 1).astype(np.float32)
        for k in names:
            m = moments[k]
            m[0] = 0.9 * m[0] + 0.1 * grad[k]
            m[1] = 0.99 * m[1] + 0.01 * grad[k] ** 2
            setattr(net, k, getattr(net, k) - RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-7))
        for k in names[:4]:
            setattr(net, k, getattr(net, k).astype(np.float32))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.intercept = float(net.intercept) + float(np.log(prior / (1 - prior)))
    return net


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4))


HELD_OUT = 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network for the rows of docs that have a label, without those of the held-out fold."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold() != HELD_OUT))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5
    if len(total) < 2:
        return constant(prior)
    pick = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct() for k in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), common.as_bytes(text_col)).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row of an id and label, however often it is repeated

    got = sorted((r["label"], bytes(r["text"])) for r in rows.collect() if r["text"])
    return train([(label, *chunks([text])[:2]) for label, text in got], prior)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    net = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(net.value.scores(b.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == HELD_OUT).alias("held_out"), common.as_bytes(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches THRESHOLD."""
    net, at = docs.sparkSession.sparkContext.broadcast(network), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(net.value.scores(texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def crc_fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
