"""What the corpus operators share: the shared folder, word hashes, packing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; bounds the memory of word_hashes().
CHUNK = 1 << 20

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_R = np.uint64(0x9E3779B97F4A7C13)
_Q = np.uint64(0xD1342543DE82EF95)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session (as in tests) may go without: there the driver is the only machine.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/glyphflow-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that scratch() named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_bytes(column: str, name: str = "text"):
    """The column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary").alias(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: np.uint64) -> np.uint64:
    return np.uint64(pow(int(a), -1, 1 << 64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, by in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_bytes_powers, _word_powers = _Powers(_R), _Powers(_Q)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _bytes_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(texts: list[bytes], white: np.ndarray = _WHITE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where they begin and end in the texts joined by line feeds."""
    buf = b"\n".join(texts) + b"\n"
    at, found = 0, []
    while at < len(buf):
        to = min(len(buf), at + CHUNK)
        if to < len(buf):
            m = _SPACE.search(buf, to)
            to = m.end() if m else len(buf)
        data = np.frombuffer(buf, np.uint8, to - at, at)
        inside = ~white[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        found.append((_hash_runs(data if fold is None else fold[data], starts, ends), starts + at, ends + at))
        at = to
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, ends


def word_hashes(texts: list[bytes], white: np.ndarray = _WHITE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each.

    white marks the bytes between words (ASCII white space by default; it has to
    include the line feed); fold maps bytes before they are hashed.
    """
    hashes, starts, _ = word_spans(texts, white, fold)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, np.diff(first)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size consecutive words: len(words) - size + 1 of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _word_powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """First index of each run, given the lengths of the runs."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in one of the windows of size words at starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:n]) > 0


def groups(texts: list, limit: int = 4 << 20) -> list[slice]:
    """Consecutive texts of at most limit bytes together (a longer one alone): bounds the arrays made from them."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append(slice(begin, k))
            begin, size = k, 0
        size += len(t) + 1
    return [*out, slice(begin, len(texts))] if texts else []


def digest_hex(text: bytes) -> str:
    from hashlib import sha256

    return sha256(text).hexdigest()
