"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie end to end in one array of symbols with links
to the neighbours.  An index maps every adjacent pair that has a merge rank to
all positions where it stands.  Ranks are taken in ascending order, in blocks of
consecutive ranks none of whose pairs holds a token that the block makes: no merge
of a block can enter a pair of it, so all its positions are merged at once, and of
pairs that overlap the lower rank goes first (of one rank, the left one).  Each
block takes the neighbouring pairs out of date and enters the new ones, whose ranks
lie in later blocks.  That needs a vocabulary where each token has one merge and no
merge comes before one that it needs (checked when the file is read); then the
order gives what the library gives.

Chunks between spaces are remembered with their ids, so a batch indexes only the
words of chunks not seen before; a text's encoding is the concatenation of its chunks' ids.  Decoding maps
ids back to tokens and joins them as the file's decoder asks (none: by spaces).

Scale: a map over batches, no shuffle and no state beyond the bounded memo.

Edge cases: null is the empty text (no ids, empty decoding); a text of any length
is encoded whole; repeated rows, empty tables and further columns are as usual
for a map.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of words that one index is made of (a longer word alone); bounds its arrays.
INDEX = 1 << 20

#: Chunks, and characters of them, that one Python worker remembers at most.
MEMO, MEMO_SIZE = 500_000, 16 << 20

#: Unicode's White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Characters that str.split() takes for white space and the vocabulary does not.
NOT_WHITE = "\x1c\x1d\x1e\x1f"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def distinct(where: np.ndarray) -> np.ndarray:
    """The distinct positions in order; np.unique() is several times slower on them."""
    where = np.sort(where)
    return where[np.concatenate([[True], where[1:] != where[:-1]])]


def joined(ends: np.ndarray, parts: pa.Array) -> list[str]:
    """Consecutive runs of parts, each joined by spaces; ends has 0 and the end of each run."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), parts), pa.scalar(" ", parts.type)).to_pylist()


class WordBPE:
    """Reads a tokenizers file of byte-level BPE with word ends, and encodes and decodes as it says."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or model["type"] != "BPE" or model["unk_token"]:
            raise ValueError(f"not a lower-case byte-level BPE with word ends: {path}")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        if len({made for _, made in self.merges.values()}) != len(self.merges):
            raise ValueError("a token has two merges")
        self.pairs = sorted(self.merges, key=lambda p: self.merges[p][0])
        self.tabulate()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", " ")
        self.words_of = regex.compile(pattern).findall
        self.white = re.compile(f"[{WHITE}]+")
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        #: chunk without spaces -> its ids and its tokens, as text joined by spaces
        self.ids: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self.forget()

    def tabulate(self) -> None:
        """The merges and the symbols of bytes as arrays, and where the blocks of independent ranks begin."""
        self.none = max(self.tokens) + 1
        self.made = np.array([self.merges[p][1] for p in self.pairs], np.int32)
        keys = np.array([a * (self.none + 1) + b for a, b in self.pairs], np.int64)
        self.rank_of = np.append(np.argsort(keys), len(keys)).astype(np.int32)
        self.keys = np.append(np.sort(keys), np.iinfo(np.int64).max)
        self.begins: list[int] = []
        later, block = set(self.made.tolist()), set()
        for rank, (pair, made) in enumerate(zip(self.pairs, self.made.tolist(), strict=True)):
            if not later.isdisjoint(pair):
                raise ValueError("a merge comes before one that it needs")
            if rank == 0 or not block.isdisjoint(pair):
                self.begins.append(rank)
                block = set()
            later.discard(made)
            block.add(made)
        self.block_of = np.append(np.searchsorted(self.begins, np.arange(len(keys)), "right") - 1, len(self.begins)).astype(np.min_scalar_type(len(self.begins)))
        chars = byte_chars()
        self.inner = np.array([self.vocab.get(c, -1) for c in chars], np.int32)
        self.outer = np.array([self.vocab.get(c + self.end, -1) for c in chars], np.int32)
        self.decimals = pa.array(map(str, range(self.none)), pa.large_string())
        self.written = pa.array([self.tokens.get(i, "") for i in range(self.none)], pa.large_string())

    def forget(self) -> None:
        self.held = 0
        self.ids = {text: str(i) for text, i in self.special.items()}
        self.names = {text: text for text in self.special}

    def chunks(self, text: str) -> list[str]:
        """The normalised runs between white space in order (no word crosses it); special strings stand for themselves."""
        if "<" in text and len(parts := self.split(text)) > 1:
            return [c for k, p in enumerate(parts) for c in ([p] if k % 2 else self.chunks(p))]
        if not text.isascii():  # lower() would look at a sigma's neighbours
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in NOT_WHITE):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words end to end, one that no pair has before and after each word, and where words begin."""
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8) if raw else np.zeros(1, np.uint8)
        sym = self.inner[data]
        sym[ends - 1] = self.outer[data[ends - 1]]
        sym[0] = self.none
        sym[ends] = self.none
        if (sym < 0).any():
            raise KeyError("a byte without a token")
        return sym, np.concatenate([[0], ends])[:-1] + 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; for no pair, the number of ranks."""
        keys = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.rank_of[at], len(self.pairs))

    def index_and_merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end and the number of each word's, from one pair occurrence index over all of them."""
        sym, first = self.symbols(words)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, len(self.pairs), np.int32)
        gone = np.zeros(n, bool)
        at: list[list[np.ndarray]] = [[] for _ in range(len(self.begins))]

        def enter(where: np.ndarray) -> None:
            rank[where] = self.ranks(sym[where], sym[after[where]])
            where = where[rank[where] < len(self.pairs)]
            blocks = self.block_of[rank[where]]
            order = np.argsort(blocks, kind="stable")
            blocks, where = blocks[order], where[order]
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(where)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    at[int(blocks[i])].append(where[i:j])

        enter(np.arange(n - 1))
        for block, entered in enumerate(at):
            if not entered:
                continue
            where = distinct(np.concatenate(entered))
            where = where[~gone[where] & (self.block_of[rank[where]] == block)]
            merged = []
            while len(where):
                now, rest = self.next_of(where, rank[where], after[where])
                taken = after[now]
                sym[now] = self.made[rank[now]]
                gone[taken] = True
                after[now] = after[taken]
                before[after[now]] = now
                merged.append(now)
                where = rest
            if merged:
                now = np.concatenate(merged)
                enter(distinct(np.concatenate([now, before[now]])))
            at[block] = []
        kept = ~gone & (sym != self.none)
        return sym[kept], np.add.reduceat(kept.astype(np.int64), first) if len(first) else first

    @staticmethod
    def next_of(where: np.ndarray, rank: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one block's positions in order, those that no overlapping pair goes before, and those still to be decided.

        The lower rank goes first; of one rank, every second position of a run from its left.
        """
        linked = after[:-1] == where[1:]
        if not linked.any():
            return where, where[:0]
        same = linked & (rank[:-1] == rank[1:])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        ends = np.concatenate([starts[1:], [len(where)]]) - 1
        of = rank[starts]
        free = np.ones(len(starts), bool)
        joined = linked[ends[:-1]]
        free[1:] &= ~joined | (of[1:] < of[:-1])
        free[:-1] &= ~joined | (of[:-1] < of[1:])
        size = ends - starts + 1
        now = np.repeat(free, size) & ((np.arange(len(where)) - np.repeat(starts, size)) % 2 == 0)
        rest = ~now
        rest[1:] &= ~(linked & now[:-1])
        rest[:-1] &= ~(linked & now[1:])
        return where[now], where[rest]

    def learn(self, chunks: set[str]) -> None:
        """Index the distinct words of chunks not seen before, and keep the chunks' encodings."""
        alone = [c for c in chunks if c.isascii() and c.isalpha()]  # one word
        others = {c: self.words_of(c) for c in chunks.difference(alone)}
        words = [*alone, *set().union(*others.values()).difference(alone)]
        ids: list[str] = []
        names: list[str] = []
        for part in common.groups(words, INDEX):
            found, counts = self.index_and_merge(words[part])
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids += joined(ends, self.decimals.take(pa.array(found)))
            names += joined(ends, self.written.take(pa.array(found)))
        self.held += sum(map(len, chunks))
        for memo, made in ((self.ids, ids), (self.names, names)):
            memo.update(zip(alone, made, strict=False))
            of = dict(zip(words, made, strict=True))
            for c, ws in others.items():
                memo[c] = " ".join([of[w] for w in ws])

    def texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Of each text, its decimal ids and its tokens, both joined by spaces."""
        todo: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            todo.append(self.chunks(text))
            size += len(text)
            if size > 1 << 21 or k + 1 == len(texts):
                if len(self.ids) > MEMO or self.held > MEMO_SIZE:
                    self.forget()
                self.learn(set().union(*todo).difference(self.ids))
                for chunks in todo:
                    yield " ".join(map(self.ids.__getitem__, chunks)), " ".join(map(self.names.__getitem__, chunks))
                todo, size = [], 0

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.texts([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces; ids without a token are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_coders: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    if path not in _coders:
        _coders[path] = WordBPE(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            ids = [[int(i) for i in x.split()] for x, _ in bpe.texts(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() without shipping the ids and tokens themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for x, names in bpe.texts(b.column(1).to_pylist()):
                n.append(x.count(" ") + 1 if x else 0)
                ids.append(sha256(x.encode()).hexdigest())
                decoded.append(sha256(names.encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
