"""Language identification by ranked character trigrams, trained from labelled texts.

Trigrams are numbers of three code points, so that they sort as their strings do, and
are counted and ranked as arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a profile; a trigram that a profile lacks, or that ranks further away, counts as so many places.
TOP = 300

#: Distinct trigrams that a worker holds while it counts, and bytes of text counted at once.
HELD, PIECE = 1 << 20, 1 << 20

_BITS = 21


@cache
def _letters() -> np.ndarray:
    """By code point whether it is a letter; there are none beyond the last place."""
    return np.array([chr(c).isalpha() for c in range(0x3FFFF)] + [False])


def _codes(text: str) -> np.ndarray:
    """Trigrams of the text's runs of letters, in small letters and parted by single spaces, with one before and after."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[np.minimum(points, 0x3FFFF)]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after a run
    padded = np.empty(int(kept.sum()) + 2, np.int64)
    padded[0] = padded[-1] = 0x20
    padded[1:-1] = np.where(letter, points, 0x20)[kept]
    if len(padded) > 2 and padded[-2] == 0x20:
        padded = padded[:-1]
    return padded[:-2] << 2 * _BITS | padded[1:-1] << _BITS | padded[2:] if len(padded) > 2 else np.empty(0, np.int64)


def _name(code: int) -> str:
    return "".join(chr(code >> k * _BITS & (1 << _BITS) - 1) for k in (2, 1, 0))


def _code(name: str) -> int:
    a, b, c = map(ord, name)
    return a << 2 * _BITS | b << _BITS | c


def trigrams(text: str) -> Counter[str]:
    """Trigrams of a text and how often each stands in it."""
    found, n = np.unique(_codes(text), return_counts=True)
    return Counter(dict(zip(map(_name, found.tolist()), n.tolist(), strict=True)))


@dataclass(frozen=True)
class LanguageModel:
    """Rank profiles by language; the nearest profile by sum of rank differences over all trigrams of a text wins."""

    profiles: dict[str, dict[str, int]]

    def __hash__(self) -> int:
        return hash(tuple(sorted((k, len(p)) for k, p in self.profiles.items())))

    @cached_property
    def _ranks(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Trigrams of any profile, and of each profile their ranks, far away where it lacks them."""
        known = sorted({_code(g) for p in self.profiles.values() for g in p if len(g) == 3})
        at = {c: i for i, c in enumerate(known)}
        ranks = {}
        for k, p in self.profiles.items():
            ranks[k] = np.full(len(known), 1 << 40, np.int64)
            for g, rank in p.items():
                if len(g) == 3:
                    ranks[k][at[_code(g)]] = rank
        return np.array(known, np.int64), ranks

    def detect(self, text: str, allow: tuple[str, ...] | None = None) -> str | None:
        found, n = np.unique(_codes(text), return_counts=True)
        if not len(found):
            return None
        ranked = found[np.argsort(-n, kind="stable")]  # ties by trigram
        known, ranks = self._ranks
        if not len(known):
            scores = {k: TOP * len(ranked) for k in self.profiles if allow is None or k in allow}
        else:
            at = np.minimum(np.searchsorted(known, ranked), len(known) - 1)
            there = np.flatnonzero(known[at] == ranked)
            rest = TOP * (len(ranked) - len(there))
            scores = {k: rest + int(np.minimum(TOP, np.abs(r[at[there]] - there)).sum()) for k, r in ranks.items() if allow is None or k in allow}
        return min(scores, key=lambda k: (scores[k], k)) if scores else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, g, count: trigrams by language, summed before they leave the worker."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for lang, arrays in waiting.items():
            codes, n = np.unique(np.concatenate(arrays), return_counts=True)
            if lang in held:
                before, counts = held[lang]
                both, at = np.unique(np.concatenate([before, codes]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, at, np.concatenate([counts, n]))
                codes, n = both, total
            held[lang] = codes, n
        waiting.clear()

    def told() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            for k in range(0, len(codes), 1 << 16):
                part = codes[k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "g": pa.array(list(map(_name, part.tolist())), pa.string()), "n": pa.array(n[k : k + (1 << 16)].astype(np.int64))})
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            codes = _codes(text.as_py())
            waiting.setdefault(lang.as_py(), []).append(codes)
            size += len(codes)
            if size > PIECE:
                settle()
                size = 0
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from told()
    settle()
    yield from told()


def train(texts: DataFrame, language_col: str, text_col: str = "text") -> LanguageModel:
    """Workers sum trigrams before they are grouped; only TOP a language come to the driver."""
    rows = texts.select(F.col(language_col).alias("lang"), F.col(text_col).alias("t")).filter("lang IS NOT NULL AND t IS NOT NULL")
    grams = rows.mapInArrow(_counted, "lang string, g string, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("count"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "g")
    top = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).collect()
    profiles: dict[str, dict[str, int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], {})[r["g"]] = r["rank"] - 1
    return LanguageModel(profiles)
