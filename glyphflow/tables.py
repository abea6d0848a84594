"""Fixed tables: scripts, languages, separators; and the patterns built from them.

All patterns are plain classes of code-point ranges, so that one table serves
Java, RE2 and Python.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

Ranges = tuple[tuple[int, int], ...]


def _ranges(text: str) -> Ranges:
    out = []
    for part in text.split():
        lo, _, hi = part.partition("-")
        out.append((int(lo, 16), int(hi or lo, 16)))
    return tuple(out)


#: Code points of each script.  Where two claim one, the earlier has it.
SCRIPT_RANGES: dict[str, Ranges] = {
    "Latin": _ranges("41-5A 61-7A 80-24F 250-2AF 1D00-1DBF 1E00-1EFF 2100-214F 2C60-2C7F A720-A7FF AB30-AB6F"),
    "Cyrillic": _ranges("400-484 487-52F 2DE0-2DFF A640-A69D A69F 1D2B 1D78"),
    "Arabic": _ranges("600-6FF 750-7FF 8A0-8FF FB50-FDFF FE70-FEFF 10E60-10E7F 1EE00-1EEFF"),
    "Devanagari": _ranges("900-97F A8E0-A8FF 1CD0-1CFF"),
    "Hebrew": _ranges("590-5FF"),
    "Ethiopic": _ranges("1200-139F 2D80-2DDF AB00-AB2F"),
    "Georgian": _ranges("10A0-10FF"),
    "Bengali": _ranges("980-9FF"),
    "Hangul": _ranges("AC00-D7AF 1100-11FF 3130-318F 3200-32FF A960-A97F D7B0-D7FF FF00-FFEF"),
    "Cj": _ranges("3040-309F 30A0-30FF 2E80-2E99 2E9B-2EF3 2F00-2FD5 3005 3007 3021-3029 3038-303B 3400-4DB5 4E00-9FCC F900-FA6D FA70-FAD9"),
    "Greek": _ranges("370-3FF"),
    "Kannada": _ranges("C80-CFF"),
    "Tamil": _ranges("B80-BFF"),
    "Thai": _ranges("E00-E7F"),
    "Gujarati": _ranges("A80-AFF"),
    "Gurmukhi": _ranges("A00-A7F"),
    "Telugu": _ranges("C00-C7F"),
    "Malayalam": _ranges("D00-D7F"),
    "Oriya": _ranges("B00-B7F"),
    "Myanmar": _ranges("1000-109F"),
    "Sinhala": _ranges("D80-DFF"),
    "Khmer": _ranges("1780-17FF 19E0-19FF"),
}

#: Alphabets that are parts of a script.
PART_RANGES: dict[str, Ranges] = {
    "Hiragana": _ranges("3040-309F"),
    "Katakana": _ranges("30A0-30FF"),
    "Mandarin": _ranges("2E80-2E99 2E9B-2EF3 2F00-2FD5 3005 3007 3021-3029 3038-303B 3400-4DB5 4E00-9FCC F900-FA6D FA70-FAD9"),
    "Persian": _ranges("67E 686 698 6A9 6AF 6C0 6CC 6F0-6F9"),
}

#: Scripts that no code point decides (a detector may still name them).
SCRIPTS: tuple[str, ...] = (*SCRIPT_RANGES, "Armenian", "Other")

#: The languages by ISO 639-3 code.
LANGUAGES: tuple[str, ...] = tuple(
    "epo eng rus cmn spa por ita ben fra deu ukr kat ara hin jpn heb yid pol amh jav kor nob dan swe fin tur nld hun ces ell bul bel mar kan ron slv hrv srp mkd lit lav est tam vie urd tha guj uzb pan aze ind tel pes mal ori mya nep sin khm tuk aka zul sna afr lat slk cat tgl hye".split()
) + ("zho",)


def language_from_code(code: str) -> str | None:
    return code if code in LANGUAGES else None


def detector_language(code: str) -> str:
    """The code under which detectors know a language: they have one for Chinese."""
    return "cmn" if code == "zho" else code


def script_name(script: str) -> str:
    return {"Cj": "Mandarin", "Other": "other"}.get(script, script)


def script_from_name(name: str) -> str:
    return {"Mandarin": "Cj"}.get(name, name if name in SCRIPTS and name not in ("Cj", "Other") else "Other")


@cache
def _script_starts() -> tuple[list[int], list[str]]:
    owner: dict[int, str] = {}
    for name, ranges in reversed(SCRIPT_RANGES.items()):
        for lo, hi in ranges:
            owner.update(dict.fromkeys(range(lo, hi + 1), name))
    starts, names, last = [0], ["Other"], "Other"
    for cp in sorted(owner):
        if owner[cp] != last or cp - 1 not in owner:
            starts.append(cp)
            names.append(owner[cp])
            last = owner[cp]
        if cp + 1 not in owner:
            starts.append(cp + 1)
            names.append("Other")
            last = "Other"
    return starts, names


def is_in(char: str, name: str) -> bool:
    """Whether a character is in the ranges of a script or of a part of one."""
    return _in(ord(char), SCRIPT_RANGES.get(name) or PART_RANGES[name])


@cache
def script_of(char: str) -> str:
    starts, names = _script_starts()
    return names[bisect_right(starts, ord(char)) - 1]


def _merge(points: set[int]) -> Ranges:
    out: list[list[int]] = []
    for cp in sorted(points):
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return tuple((a, b) for a, b in out)


#: Separators follow from Unicode 15.1's categories but for these (fixed values).
_CATEGORIES = frozenset("Pc Pd Pe Pf Pi Po Ps Sm Zl Zp Zs".split())
_KEPT_MATH = _ranges("2B B1 D7 F7 2212-2225 2227-228D 228F-22FF")
_LEFT_OUT = _ranges(
    "A0 2000-2001 202F 205F 2028 2011 2E5D 232A 2E56 2E58 2E5A 2E5C 2329 2E55 2E57 2E59 2E5B 37E 387 61D 66B-66C F0C 1B7D-1B7E 2E53-2E54 10F86-10F89 116B9 11B00-11B09 11F43-11F4F 12FF1-12FF2"
)
_ADDED = _ranges("0 9 A D 60 200C")
#: What later Unicode versions add to the categories stays out: the list is that of 15.1.
_AFTER_15 = 0x1FFFF
SEPARATOR_WORDS: tuple[str, ...] = (". ", ", ", "។ល។")

#: Separators that end a context, beside ". ", ", " and "។ល។".
HARD_RANGES = _ranges(
    "0 21 3B 3F A1 A7 B4 B6 BF 55C-55E 589 5C3 60C 61B 61F 6D4 700-709 7F7-7F9 830-835 838-83E 85E 964-965 DF4 E5A-E5B F04-F0A F0D-F12 F14 FD0-FD4 104A-104B 10FB 1362-1368 169B-169C 16EB-16ED 1735-1736 17D4-17D6 17D8 17DA 1800-1806 1808-1809 1944-1945 1A1F 1AA8-1AAD 1B5A-1B60 1BFC-1BFF 1C3B-1C3F 1C7E-1C7F 1CC0-1CC7 2024-2026 203B-203D 2047-2049 204F 2056 205A 2CF9-2CFC 2CFE 2E18 2E2E 2E41 3001-3002 A4FE-A4FF A60D-A60F A6F2-A6F7 A876-A877 A8CE-A8CF A92F A95F A9C3-A9CD AA5C-AA5F AADF AAF0-AAF1 ABEB FE10-FE16 FE19 FE30 FE45 FE50-FE52 FE54-FE57 FF01 FF0C FF0E FF1A-FF1B FF1F FF61 FF64 10857 10A50-10A58 10AF0-10AF5 10B3A-10B3F 10B99-10B9C 10F55-10F59 11047-1104D 110BE-110C1 11140-11143 11175 111C5-111C6 111CD 111DE-111DF 11238-11239 1123B-1123C 112A9 1144B-1144D 1145A 115C2-115C3 115C9-115D7 11641-11642 11660-1166C 1173C-1173E 11944 11946 11A3F-11A46 11A9A-11A9C 11A9E-11AA2 11C41-11C42 11C70-11C71 11EF7-11EF8 11FFF 12471-12474 16A6E-16A6F 16AF5 16B37-16B39 16B44 16E97-16E9A 1BC9F 1DA87-1DA8A 1E95E-1E95F"
)


def _in(cp: int, ranges: Ranges) -> bool:
    return any(lo <= cp <= hi for lo, hi in ranges)


@cache
def separator_ranges() -> Ranges:
    """Ranges of the 1,049 default separators of one character."""
    points = {cp for lo, hi in _ADDED for cp in range(lo, hi + 1)}
    for cp in range(_AFTER_15 + 1):
        kind = unicodedata.category(chr(cp))
        if kind in _CATEGORIES and not _in(cp, _LEFT_OUT) and (kind != "Sm" or _in(cp, _KEPT_MATH)):
            points.add(cp)
    return _merge(points)


@cache
def separator_chars() -> frozenset[str]:
    return frozenset(chr(cp) for lo, hi in separator_ranges() for cp in range(lo, hi + 1))


@cache
def separators() -> frozenset[str]:
    return separator_chars() | frozenset(SEPARATOR_WORDS)


@cache
def hard_separators() -> frozenset[str]:
    return frozenset(chr(cp) for lo, hi in HARD_RANGES for cp in range(lo, hi + 1)) | frozenset(SEPARATOR_WORDS)


# -- patterns ---------------------------------------------------------------


def char_class(ranges: Ranges, python: bool = False) -> str:
    """The inside of a character class; \\x{...} for Java and RE2."""

    def one(cp: int) -> str:
        return f"\\U{cp:08x}" if python else f"\\x{{{cp:X}}}"

    return "".join(one(lo) if lo == hi else f"{one(lo)}-{one(hi)}" for lo, hi in ranges)


def ascii_only(ranges: Ranges) -> Ranges:
    return tuple((lo, min(hi, 0x7F)) for lo, hi in ranges if lo <= 0x7F)


def split_pattern(ranges: Ranges | None = None, python: bool = False) -> str:
    """All separators and what lies between, by default rules; a separator of more characters first."""
    s = char_class(separator_ranges() if ranges is None else ranges, python)
    etc = "។ល។" if python else "\\x{17D4}\\x{179B}\\x{17D4}"
    return f"\\. |, |{etc}|[{s}]|[^{s}]+"


def literal(text: str) -> str:
    """A literal for Java, RE2 and Python."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def alternation(words: tuple[str, ...] | frozenset[str]) -> str:
    """Leftmost-longest as leftmost-first: longer alternatives first."""
    return "|".join(literal(w) for w in sorted({w for w in words if w}, key=lambda w: (-len(w), w)))


def gap_pattern(words: tuple[str, ...]) -> str:
    """Group 1: a gap; group 2: the word after it, empty at the end of the text."""
    return f"(?s)(.*?)({alternation(words)}|\\z)"


@cache
def other_ranges() -> Ranges:
    """Code points of no script, without surrogates."""
    owned = sorted((lo, hi) for ranges in SCRIPT_RANGES.values() for lo, hi in ranges) + [(0xD800, 0xDFFF)]
    out, at = [], 0
    for lo, hi in sorted(owned):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    out.append((at, 0x10FFFF))
    return tuple(out)


@cache
def exclusive_ranges(script: str) -> Ranges:
    points: set[int] = set()
    for lo, hi in SCRIPT_RANGES[script]:
        points.update(range(lo, hi + 1))
    for name, ranges in SCRIPT_RANGES.items():
        if name == script:
            break
        for lo, hi in ranges:
            points.difference_update(range(lo, hi + 1))
    return _merge({p for p in points if not 0xD800 <= p <= 0xDFFF})


@cache
def group_pattern(python: bool = False) -> str:
    """Maximal runs of one script; characters of no script stay with the run before, or lead the first."""
    o = char_class(other_ranges(), python)
    runs = "|".join(f"[{(x := char_class(exclusive_ranges(s), python))}][{x}{o}]*" for s in SCRIPT_RANGES)
    end = r"\Z" if python else r"\z"
    return f"\\A[{o}]+{end}|(?:\\A[{o}]+)?(?:{runs})"
