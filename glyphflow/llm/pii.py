"""Personal data replaced by format-preserving Feistel pseudonyms.

Found values are validated, ranked within their format (all strings the format
allows, numbered), permuted by a keyed Feistel network over that range, and
written back in the same format: a card number becomes another card number with a
right check digit, a date another date written alike.  Equal values get equal
pseudonyms in all documents, whatever stands around them, and the key holder can
undo it.  There is no key in this library: the caller gives one.

Kinds, in the order in which overlapping finds are settled (fixed values):
email; ip (four parts up to 255); card (13 to 19 digits, right Luhn digit, one
separator style); ssn (US, area not 000, 666 or 9xx, group not 00, serial not
0000); phone (US numbers of ten digits with country code or separators, exchange from 200;
area code from 200, or any where + or brackets mark the number); iban (right check digits); date (year-month-day,
day.month.year or month/day/year with an existing day, 1900 to 2099).
A number that fails its validation stays as it is.

The Feistel network is balanced over the next even number of bits; values beyond
the range are sent through again (cycle walking), which ends inside the range.
A value may be its own image, as in any permutation: with probability one in the
size of the range (the smallest: 73,049 dates; very short mail names).

Scale: a map without a shuffle, linear in the text however many finds it has; rows without a digit or an @ are passed through
after one look.

Edge cases: null text stays null and has no finds; empty text stays empty; values
at either end of a text count; a value repeated in a text is replaced each time;
repeated rows, empty tables and further columns are as usual for a map.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(value: int, size: int, key: bytes, tweak: bytes, undo: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            seen = left if undo else right
            text = bytes([r]) + tweak + seen.to_bytes((half + 7) // 8, "big")
            f = int.from_bytes(hashlib.blake2b(text, key=key, digest_size=min(64, (half + 7) // 8 + 8)).digest(), "big") & mask
            left, right = (right ^ f, left) if undo else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def _permute(places: list[tuple[str, str]], key: bytes, tweak: str, undo: bool) -> str:
    """places: (character, the alphabet it is from; empty: it stays)."""
    rank, size, shape = 0, 1, []
    for c, letters in places:
        if letters:
            rank, size = rank * len(letters) + letters.index(c), size * len(letters)
        shape.append(letters or c)
    rank = feistel(rank, size, key, f"{tweak}:{size}".encode(), undo)
    out = []
    for c, letters in reversed(places):
        if letters:
            rank, i = divmod(rank, len(letters))
            c = letters[i]
        out.append(c)
    return "".join(reversed(out))


def _alphabet(c: str) -> str:
    return next((a for a in (DIGITS, LOWER, UPPER) if c in a), "")


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a right number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _fill(text: str, digits: str) -> str:
    """text with its digits exchanged in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def _email(text: str, key: bytes, undo: bool) -> str:
    # everything but the last label: the mail name and the name of the host
    keep = text.rindex(".")
    return _permute([(c, _alphabet(c)) for c in text[:keep]], key, "email", undo) + text[keep:]


def _ip(text: str, key: bytes, undo: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    n = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip", undo)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _card(text: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) or len(set(digits)) == 1 or not 13 <= len(digits) <= 19:
        return None
    body = _permute([(c, DIGITS) for c in digits[:-1]], key, "card", undo)
    return _fill(text, body + str(-luhn(body + "0") % 10))


def _ranged(text: str, parts: tuple[tuple[int, Callable[[int], bool]], ...], key: bytes, tweak: str, undo: bool, skip: int = 0) -> str | None:
    """Digits in groups that each take certain numbers only; skip digits in front stay."""
    digits = re.sub(r"\D", "", text)
    rank, size, at, tables = 0, 1, skip, []
    for width, allowed in parts:
        table, where = _numbers(width, allowed)
        if (n := int(digits[at : at + width])) not in where:
            return None
        rank, size, at = rank * len(table) + where[n], size * len(table), at + width
        tables.append((width, table))
    rank = feistel(rank, size, key, tweak.encode(), undo)
    out = ""
    for width, table in reversed(tables):
        rank, i = divmod(rank, len(table))
        out = f"{table[i]:0{width}d}" + out
    return _fill(text, digits[:skip] + out)


@lru_cache
def _numbers(width: int, allowed: Callable[[int], bool]) -> tuple[list[int], dict[int, int]]:
    table = [n for n in range(10**width) if allowed(n)]
    return table, {n: i for i, n in enumerate(table)}


def _from_200(n: int) -> bool:
    return n >= 200


def _any(n: int) -> bool:
    return True


def _positive(n: int) -> bool:
    return n > 0


def _area(n: int) -> bool:
    return 0 < n < 900 and n != 666


def _below_200(n: int) -> bool:
    return n < 200


def _phone(text: str, key: bytes, undo: bool) -> str | None:
    """Area codes under 200 are not given out; they count where the number is marked as one."""
    skip = len(re.sub(r"\D", "", text)) - 10
    exact = _ranged(text, ((3, _from_200), (3, _from_200), (4, _any)), key, "phone", undo, skip)
    if exact is None and ("+" in text or "(" in text):
        return _ranged(text, ((3, _below_200), (3, _from_200), (4, _any)), key, "phone-low", undo, skip)
    return exact


def _ssn(text: str, key: bytes, undo: bool) -> str | None:
    return _ranged(text, ((3, _area), (2, _positive), (4, _positive)), key, "ssn", undo)


def _iban(text: str, key: bytes, undo: bool) -> str | None:
    plain = text.replace(" ", "")
    if mod97(plain) != 1:
        return None
    body = _permute([(c, _alphabet(c)) for c in plain[4:]], key, "iban" + plain[:2], undo)
    # check digits run from 02 to 98
    it = iter(f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


FIRST = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST).days


def _date(text: str, key: bytes, undo: bool) -> str | None:
    a, sep, b, c = re.fullmatch(r"(\d+)([-./])(\d+)[-./](\d+)", text).groups()
    order = (a, b, c) if len(a) == 4 else (c, b, a) if sep == "." else (c, a, b)
    try:
        day = datetime.date(*map(int, order))
    except ValueError:
        return None
    if not 0 <= (n := (day - FIRST).days) < DAYS:
        return None
    new = FIRST + datetime.timedelta(feistel(n, DAYS, key, b"date", undo))
    if len(a) == 4:
        return f"{new:%Y}{sep}{new:%m}{sep}{new:%d}"
    return f"{new:%d}{sep}{new:%m}{sep}{new:%Y}" if sep == "." else f"{new:%m}{sep}{new:%d}{sep}{new:%Y}"


#: Kind, pattern and rewriting of each; the rewriting gives None for what isn't valid.
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
    "ip": (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _ip),
    "card": (r"(?<!\d)(?<!\d[ -])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d|[ -]\d{3})|(?<!\d)\d{13,19}(?!\d)", _card),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "phone": (r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)|(?<![\d+])\+1\d{10}(?!\d)", _phone),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)", _date),
}


@dataclass
class Pseudonymizer:
    key: bytes
    known: dict[tuple[str, str], str | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.key or len(self.key) > 64:
            raise ValueError("a key of 1 to 64 bytes is needed")
        self.patterns = [(k, re.compile(p), f) for k, (p, f) in KINDS.items()]

    def replacement(self, kind: str, rewrite: Callable[[str, bytes, bool], str | None], value: str, undo: bool) -> str | None:
        if undo:
            return rewrite(value, self.key, True)
        if len(self.known) > 100_000:
            self.known.clear()
        if (kind, value) not in self.known:
            self.known[kind, value] = rewrite(value, self.key, False)
        return self.known[kind, value]

    def spans(self, text: str, undo: bool = False) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym of all finds, in order, none overlapping."""
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))  # characters of finds so far
        for kind, pattern, rewrite in self.patterns:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                s, e = m.span()
                if not any(taken[s:e]) and (new := self.replacement(kind, rewrite, m[0], undo)) is not None:
                    found.append((s, e, kind, new))
                    taken[s:e] = b"\1" * (e - s)
        return sorted(found)

    def __call__(self, text: str, undo: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
        if not HINT.search(text):
            return text, []
        out, at, found = [], 0, self.spans(text, undo)
        for s, e, _, new in found:
            out += text[at:s], new
            at = e
        return "".join(out) + text[at:], found


#: Every kind but a mail address has two digits a few characters apart; texts with neither hold nothing.
HINT = re.compile(r"@|\d[^\n]{0,3}\d")

SPAN = "array<struct<start:int,stop:int,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """docs with text_col rewritten in place, by a key of 1 to 64 bytes that whoever runs it keeps secret; with spans_col, a column of the finds (code points of the old text) more."""
    Pseudonymizer(key)
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if spans_col:
        schema += f", `{spans_col}` {SPAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hide = Pseudonymizer(key)
        for b in batches:
            texts, spans = [], []
            for t in b.column(at).to_pylist():
                new, found = (None, []) if t is None else hide(t)
                texts.append(new)
                spans.append([{"start": s, "stop": e, "kind": k} for s, e, k, _ in found])
            cols, names = list(b.columns), list(b.schema.names)
            cols[at] = pa.array(texts, b.column(at).type)
            if spans_col:
                cols, names = [*cols, pa.array(spans, _SPAN)], [*names, spans_col]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the rewritten text, the finds and their number."""
    out = pseudonymize(docs.select("doc_id", "text"), key, spans_col="spans")
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_found"), "spans")
