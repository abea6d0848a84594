"""The tokenizer's semantics on one text, in Python.

This is what the Arrow operators run in each batch.  Catalyst versions of the
steps that built-in functions can express are in glyphflow.functions; tests hold
both against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache

from . import lexicons, tables
from .config import TokenizerConfig

CharMap = list[tuple[int, int]]

#: Results of normalisation that a worker remembers for each script and language.
MEMO = 50_000

_PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


# -- segmenters -------------------------------------------------------------


def _beginning(words: Iterable[str]) -> Callable[..., re.Match | None]:
    """Search for a place where one of the words may begin."""
    words = set(words)

    def class_of(chars: set[str]) -> str:
        return f"[{''.join(map(re.escape, sorted(chars)))}]"

    short, long = {w for w in words if len(w) == 1}, {w for w in words if len(w) > 1}
    parts = [class_of(short)] * bool(short) + [class_of({w[0] for w in long}) + class_of({w[1] for w in long})] * bool(long)
    return re.compile("|".join(parts) or "(?!)", re.S).search


class Trie:
    """Longest prefix of a text among words."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        words = [w for w in words if w]
        #: finds where a word may begin, by its first two characters
        self.may_begin = _beginning(words)
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = True

    def longest(self, text: str, at: int) -> int:
        """Length of the longest word at this place; 0 without one."""
        node, best = self.root, 0
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            if "" in node:
                best = k - at + 1
        return best


def by_longest_word(text: str, trie: Trie, buffer: int | None) -> list[str]:
    """Words, greedily; characters between words come together, at most buffer of them (None: however many)."""
    out: list[str] = []

    def between(gap: str) -> None:
        if buffer == 1:
            out.extend(gap)
        elif buffer is None or buffer < 1:
            out.append(gap)
        else:
            out.extend(gap[i : i + buffer] for i in range(0, len(gap), buffer))

    at = begin = 0
    while m := trie.may_begin(text, at):
        at = m.start()
        n = trie.longest(text, at)
        if n:
            if begin < at:
                between(text[begin:at])
            out.append(text[at : at + n])
            at += n
            begin = at
        else:
            at += 1
    if begin < len(text):
        between(text[begin:])
    return out


def camel_case(text: str) -> list[str]:
    """Parts that begin at a capital after a small letter, or at a capital before a small one."""
    cuts = [0]
    last = ""  # the character before, marks aside
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        if i and kind == "Lu" and (last == "Ll" or (i + 1 < len(text) and text[i + 1].islower())):
            cuts.append(i)
        last = kind
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b]


def arabic_article(text: str) -> list[str]:
    """The article is cut off a word of more than two letters."""
    if len(text) > 2 and text[1] == "ل" and text[0] in "اأإآٱ" and len(text.encode()) > 4:
        return [text[:2], text[2:]]
    return [text]


class Chinese:
    """The most probable path through the words found (log frequencies), then short words within long pieces."""

    def __init__(self, words: Iterable[str]) -> None:
        self.freq: dict[str, int] = {}
        for w in words:
            word, _, n = w.partition("\t")
            self.freq[word] = int(n) if n else 1000
        self.total = max(1, sum(self.freq.values()))
        self.trie = Trie(self.freq)

    def _cut(self, run: str) -> Iterator[str]:
        from math import log

        n, low = len(run), -log(self.total) * 2
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            options = [(low + best[i + 1][0], i + 1)]
            for j in range(i + 1, min(n, i + 32) + 1):
                if run[i:j] in self.freq:
                    options.append((log(self.freq[run[i:j]]) - log(self.total) + best[j][0], j))
            best[i] = max(options)
        i = 0
        while i < n:
            yield run[i : best[i][1]]
            i = best[i][1]

    def _within(self, piece: str) -> list[str]:
        if len(piece) <= 2 or (piece.isascii() and piece.isalnum()):
            return [piece]
        out, i = [], 0
        while i < len(piece):
            n = next((n for n in (2, 3) if len(piece) - i >= n and piece[i : i + n] in self.freq), 1)
            out.append(piece[i : i + n])
            i += n
        return out

    _HAN = re.compile(r"[㐀-䶵一-鿿豈-﫿]+")
    _OTHER = re.compile(r"[A-Za-z0-9]+|.", re.S)

    def __call__(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self._HAN.finditer(text):
            out += self._OTHER.findall(text, at, m.start())
            at = m.end()
            if len(m[0]) == 1:
                out.append(m[0])
            else:
                for piece in self._cut(m[0]):
                    out += self._within(piece)
        return out + self._OTHER.findall(text, at)


class Lattice:
    """The cheapest path through words: one a word, more for two nouns in a row or an unknown character.

    Words are nouns unless written with a tab and "p" (particles).
    """

    NOUNS_MEET, UNKNOWN = 3, 5

    def __init__(self, words: Iterable[str]) -> None:
        self.particle = {w.partition("\t")[0]: w.endswith("\tp") for w in words}
        self.particle.pop("", None)
        self.may_begin = _beginning(self.particle)

    def __call__(self, text: str) -> list[str]:
        """Characters that no word can begin at or reach cost the same on every path: paths are sought between them."""
        out, at = [], 0
        while m := self.may_begin(text, at):
            out += text[at : m.start()]
            at = m.start()
            end = reach = at
            while end < len(text):
                last = max((j for j in range(end + 1, min(len(text), end + 16) + 1) if text[end:j] in self.particle), default=0)
                if not last and end >= reach:
                    break
                reach = max(reach, last)
                end += 1
            if end == at:
                out.append(text[at])
                at += 1
            else:
                out += self._path(text[at:end])
                at = end
        out += text[at:]
        return out

    def _path(self, text: str) -> list[str]:
        n = len(text)
        # by place and whether the word before was a noun: cost, place before, its kind
        best: list[dict[bool, tuple[int, int, bool]]] = [{} for _ in range(n + 1)]
        best[0][False] = (0, 0, False)
        for i in range(n):
            for noun, (cost, _, _) in list(best[i].items()):
                options = [(i + 1, self.UNKNOWN, False)]
                for j in range(i + 1, min(n, i + 16) + 1):
                    if (p := self.particle.get(text[i:j])) is not None:
                        options.append((j, 1 + self.NOUNS_MEET * (noun and not p), not p))
                for j, more, kind in options:
                    if kind not in best[j] or cost + more < best[j][kind][0]:
                        best[j][kind] = (cost + more, i, noun)
        out, i = [], n
        noun = min(best[n], key=lambda k: best[n][k][0])
        while i:
            _, before, kind = best[i][noun]
            out.append(text[before:i])
            i, noun = before, kind
        return out[::-1]


SEGMENTERS = ("latin", "camel_case", "arabic", "chinese", "japanese", "korean", "thai", "khmer", "german")

#: (script, language or None) -> segmenter
REGISTRY: dict[tuple[str, str | None], str] = {
    ("Latin", None): "latin",
    ("Latin", "swe"): "latin",
    ("Latin", "deu"): "german",
    ("Cj", "cmn"): "chinese",
    ("Cj", "zho"): "chinese",
    ("Cj", "jpn"): "japanese",
    ("Hangul", "kor"): "korean",
    ("Thai", "tha"): "thai",
    ("Khmer", "khm"): "khmer",
    ("Arabic", "ara"): "arabic",
    ("Arabic", "pes"): "arabic",
}


@lru_cache(maxsize=32)
def segmenter(name: str | Callable[[str], list[str]], config: TokenizerConfig) -> Callable[[str], list[str]]:
    if callable(name):
        return name
    words = dict(config.lexicons).get(name)
    if words is None:
        words = tuple(lexicons.SEEDS.get(name, "").split(" "))
    if name == "camel_case":
        return camel_case
    if name == "arabic":
        return arabic_article
    if name == "chinese":
        return Chinese(words)
    if name == "japanese":
        return Lattice(words)
    if name in ("thai", "khmer", "korean"):
        trie = Trie(words)
        buffer = dict(config.buffers).get(name, 1)
        return lambda text: by_longest_word(text, trie, buffer)
    if name == "german":
        trie, buffer = Trie(words), dict(config.buffers).get(name)
        return lambda text: by_longest_word(text, trie, buffer)
    if name == "latin":
        return camel_case if config.camel_case else lambda text: [text]
    raise ValueError(f"unknown segmenter {name!r}")


# -- detection --------------------------------------------------------------

_ARMENIAN = re.compile("[԰-֏]")


def detect_script(text: str) -> str:
    """The script with most characters; Other if no character has one."""
    counts: dict[str, int] = {}
    for c in text:
        s = tables.script_of(c)
        if s != "Other":
            counts[s] = counts.get(s, 0) + 1
    if n := len(_ARMENIAN.findall(text)):
        counts["Armenian"] = n
    order = {s: k for k, s in enumerate(tables.SCRIPTS)}
    return min(counts, key=lambda s: (-counts[s], order[s])) if counts else "Other"


#: Languages of scripts that several share, the most likely first.
_SHARED = {"Cyrillic": ("rus", "ukr", "bul", "bel", "mkd", "srp"), "Devanagari": ("hin", "mar", "nep"), "Hebrew": ("heb", "yid"), "Arabic": ("ara", "pes", "urd"), "Bengali": ("ben",)}
#: Letters that tell a language from the others of its script.
_LETTERS = {"rus": "ыэё", "ukr": "іїєґ", "bul": "ъ", "bel": "ўі", "mkd": "ѓќѕ", "srp": "ђћ", "mar": "ळ", "yid": "װױײ", "pes": "پچژگکی۰۱۲۳۴۵۶۷۸۹", "urd": "ٹڈڑےں"}
_BY_SCRIPT = {"Ethiopic": "amh", "Georgian": "kat", "Bengali": "ben", "Hangul": "kor", "Greek": "ell", "Kannada": "kan", "Tamil": "tam", "Thai": "tha", "Gujarati": "guj", "Gurmukhi": "pan", "Telugu": "tel", "Malayalam": "mal", "Oriya": "ori", "Myanmar": "mya", "Sinhala": "sin", "Khmer": "khm", "Armenian": "hye"}


@cache
def _function_words() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in lexicons.FUNCTION_WORDS.items()}


#: Languages whose function words are not Latin.
_OTHER_SCRIPTS = frozenset(k for names in _SHARED.values() for k in names)


def _word_scores(text: str, languages: Iterable[str]) -> dict[str, int]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    known = _function_words()
    return {k: sum(w in known.get(k, ()) for w in words) for k in languages}


def detect_language(text: str, script: str, allow: tuple[str, ...] | None, model: object | None = None) -> str | None:
    """The language among those allowed (all, if None) that the text looks most like; None if unsure."""
    if allow is not None and not allow:
        return None
    if script == "Cj":
        found = "jpn" if re.search("[ぁ-ゟァ-ヿ]", text) else "cmn"
        if allow is not None and found not in allow:
            found = next((k for k in ("cmn", "jpn") if k in allow), None)
    elif script == "Arabic":
        # any letter of the narrower alphabet decides
        options = [k for k in ("urd", "pes") if (allow is None or k in allow) and any(c in _LETTERS[k] for c in text)]
        options += [k for k in _SHARED[script] if allow is None or k in allow]
        found = next(iter(options), None)
    elif script == "Latin":
        if model is not None:
            return model.detect(text, allow)
        scores = _word_scores(text, [k for k in _function_words() if k not in _OTHER_SCRIPTS and (allow is None or k in allow)])
        best = max(scores.values(), default=0)
        return min(k for k in scores if scores[k] == best) if best else None
    elif script in _SHARED:
        options = [k for k in _SHARED[script] if allow is None or k in allow]
        scores, low = _word_scores(text, options), text.lower()
        for k in options:
            scores[k] += 2 * sum(low.count(c) for c in _LETTERS.get(k, ""))
        return max(options, key=lambda k: scores[k], default=None)  # ties: the most likely
    else:
        found = _BY_SCRIPT.get(script)
    return found if allow is None or found in allow else None


def language_for(text: str, script: str, config: TokenizerConfig) -> str | None:
    allow = config.allow_list
    if allow is not None and len(allow) == 1:
        return allow[0]
    if allow is None and script == "Latin":
        return None
    return detect_language(text, script, allow, config.language_model)


# -- normalizers ------------------------------------------------------------

_NONSPACING = frozenset("Hebrew Thai Arabic Latin Greek".split())
CASED = frozenset("Latin Cyrillic Greek Georgian Armenian".split())
_SWEDISH = {unicodedata.normalize("NFD", c): c for c in "ÅåÄäÖö"}
_SWEDISH_PAIR = re.compile("|".join(_SWEDISH))
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
#: Fixed values.
PERSIAN: dict[str, str] = {**dict.fromkeys("يیىۀ", "ی"), **dict.fromkeys("كک", "ک"), **{chr(0x6F0 + d): str(d) for d in range(10)}, "،": ",", "؟": "?", "﷼": "RIAL", "‌": ""}
ARABIC: dict[str, str] = {"ـ": "", **dict.fromkeys("أإآٱ", "ا"), "ى": "ي", "ة": "ه"}
QUOTES: dict[str, str] = dict.fromkeys("’‘‛", "'")
AE_OE: dict[str, str] = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae"}
VIETNAMESE: dict[str, str] = dict.fromkeys("ÐĐđð", "d")
TURKISH: dict[str, str] = {"ı": "i"}


_BEYOND_ASCII = re.compile("[^\x00-\x7f]")


@lru_cache(maxsize=1 << 16)
def nfkd(c: str) -> str:
    return unicodedata.normalize("NFKD", c)


def _mapped(table: dict[str, str]) -> Callable[[str], str]:
    return lambda c: table.get(c, c)


def _no_mark(c: str) -> str:
    return "" if unicodedata.category(c) == "Mn" else c


def recompose_swedish(text: str) -> str:
    return _SWEDISH_PAIR.sub(lambda m: _SWEDISH[m[0]], text)


_VOWELS = {**dict.fromkeys("アカサタナハマヤラワガザダバパァャヮ", "あ"), **dict.fromkeys("イキシチニヒミリヰギジヂビピィ", "い"), **dict.fromkeys("ウクスツヌフムユルグズヅブプゥュヴ", "う"), **dict.fromkeys("エケセテネヘメレヱゲゼデベペェ", "え"), **dict.fromkeys("オコソトノホモヨロヲゴゾドボポォョ", "う")}


_KATAKANA = re.compile("[ァ-ヶ][ァ-ヶー]*")


def to_hiragana(text: str) -> str:
    """Katakana as hiragana; a long-vowel mark after one becomes its vowel."""
    return _KATAKANA.sub(lambda m: _run_to_hiragana(m[0]), text)


def _run_to_hiragana(text: str) -> str:
    out, before = [], ""
    for c in text:
        if c == "ー" and before in _VOWELS:
            out.append(_VOWELS[before])
        else:
            out.append(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c)
            before = c
    return "".join(out)


def _all_hiragana(text: str) -> bool:
    return bool(text) and all("ぁ" <= c <= "ゟ" or c == "ー" for c in text)


class _Unlike(Exception):
    """A character that a step maps by itself, but that its gate does not ask for."""


class _Characters(dict):
    """What steps make of each character, for str.translate(); looked up once a character."""

    def __init__(self, steps: list[tuple[str, Callable, Callable[[str], str]]]) -> None:
        self.steps = steps

    def __missing__(self, point: int) -> str:
        out = chr(point)
        for name, _, one in self.steps:
            if name == "lowercase" and any(c != c.lower() and not c.isupper() for c in out):
                raise _Unlike
            out = "".join(map(one, out))
        self[point] = out
        return out


class Normalizer:
    """Normalises and classifies segments of one configuration."""

    def __init__(self, config: TokenizerConfig) -> None:
        self.config = config
        self.separators = tables.separators() if config.separators is None else frozenset(config.separators)
        pairs = [(a, b) for a, _, b in lexicons.KVARIANTS] if config.kvariants is None else config.kvariants
        self.variants = dict(pairs)
        self.pinyin = dict(config.pinyin)
        self.known: dict[tuple[str, str | None], dict[str, tuple]] = {}
        self.known_changes: dict[str, str] = {}
        self.known_tables: dict[tuple[str, str | None], tuple[_Characters, _Characters]] = {}

    def chinese(self, c: str) -> str:
        if self.pinyin:
            c = self.pinyin.get(c, c)
        return self.variants.get(c, c)

    def classify(self, lemma: str) -> tuple[str, str | None]:
        if lemma in self.config.stop_words:
            return "stop_word", None
        if lemma in self.separators:
            return "separator", "hard" if lemma in tables.hard_separators() else "soft"
        return "word", None

    def steps(self, script: str, language: str | None) -> Iterator[tuple[str, Callable[[str], bool], Callable[[str], str]]]:
        """(name, gate on the lemma, mapping of a character) in order; "classify" stands in its place."""
        yield "nfkd", lambda s: not s.isascii() and not unicodedata.is_normalized("NFKD", s), nfkd
        if language == "swe":
            yield "swedish", lambda s: bool(_SWEDISH_PAIR.search(s)), recompose_swedish
        yield "control", lambda s: bool(_CONTROL.search(s)), lambda c: "" if _CONTROL.match(c) else c
        yield "classify", lambda s: True, str
        if script == "Arabic" and language == "pes":
            yield "persian", lambda s: any(c in PERSIAN for c in s), _mapped(PERSIAN)
        if self.config.lossy:
            yield from self._lossy(script, language)
        for name, wanted, one in self.config.normalizers:
            yield name, lambda s, wanted=wanted: wanted(s, script, language), one

    def _lossy(self, script: str, language: str | None) -> Iterator[tuple[str, Callable[[str], bool], Callable[[str], str]]]:
        latin, cj = script == "Latin", script == "Cj"
        if script in CASED:
            yield "lowercase", lambda s: any(c.isupper() for c in s), str.lower
        if latin:
            yield "quote", lambda s: any(c in QUOTES for c in s), _mapped(QUOTES)
            yield "ae_oe", lambda s: any(c in AE_OE for c in s), _mapped(AE_OE)
        if cj and language in (None, "cmn", "zho"):
            yield "chinese", lambda s: True, self.chinese
        if cj and language in (None, "jpn"):
            yield "japanese", lambda s: not _all_hiragana(s), str
        if script == "Greek":
            yield "greek", lambda s: True, str
        if script == "Arabic":
            yield "arabic", lambda s: any(c in ARABIC for c in s), _mapped(ARABIC)
        if script in _NONSPACING:
            yield "nonspacing", lambda s: not s.isascii() and any(unicodedata.category(c) == "Mn" for c in s), _no_mark
        if latin:
            yield "vietnamese", lambda s: any(c in VIETNAMESE for c in s), _mapped(VIETNAMESE)
            yield "turkish", lambda s: "ı" in s, _mapped(TURKISH)

    def one(self, name: str, text: str, script: str, language: str | None, gated: bool) -> str:
        """A single step by its name; with gated only where its script, language and gate ask for it."""
        if gated:
            step = next((s for s in self.steps(script, language) if s[0] == name), None)
            if step is None or not step[1](text):
                return text
            return self.apply(name, step[2], text, None, False)[0]
        for s, language_ in (("Arabic", "pes"), ("Latin", "swe"), ("Cj", None), ("Greek", None), (script, language)):
            for step in self.steps(s, language_):
                if step[0] == name:
                    return self.apply(name, step[2], text, None, False)[0]
        raise ValueError(f"unknown normaliser {name!r}")

    def single(self, name: str, script: str, language: str | None, gated: bool) -> Callable[[str], str]:
        """one() for many texts: where a step maps character by character, its gate changes nothing."""
        found = None if gated else [s for a, b in (("Arabic", "pes"), ("Latin", "swe"), ("Cj", None), ("Greek", None), (script, language)) for s in self.steps(a, b)]
        step = next((s for s in (self.steps(script, language) if found is None else found) if s[0] == name), None)
        if step is None or name in ("swedish", "japanese", "greek") or any(name == n for n, _, _ in self.config.normalizers):
            return lambda text: self.one(name, text, script, language, gated)
        table = _Characters([step])

        def run(text: str) -> str:
            try:
                return text.translate(table)
            except _Unlike:
                return self.one(name, text, script, language, gated)

        return run

    @staticmethod
    def apply(name: str, one: Callable[[str], str], lemma: str, chars: CharMap | None, track: bool) -> tuple[str, CharMap | None]:
        if name == "japanese":
            return to_hiragana(lemma), chars
        if name == "greek":
            return (lemma[:-1] + "σ" if lemma.endswith("ς") else lemma), chars
        if name == "swedish" and (not track or chars is None):
            new: CharMap = []
            at = 0
            while at < len(lemma):
                n = 2 if _SWEDISH_PAIR.match(lemma, at) else 1
                new.append((len(lemma[at].encode()), len(recompose_swedish(lemma[at : at + n]).encode())))
                at += n
            return recompose_swedish(lemma), new if track else None
        if not track:
            return "".join(map(one, lemma)), None
        if chars is None:
            made = [one(c) for c in lemma]
            return "".join(made), [(len(c.encode()) & 255, len(m.encode()) & 255) for c, m in zip(lemma, made, strict=True)]
        raw, at, out, new = lemma.encode(), 0, [], []
        for original, n in chars:
            head = raw[at : at + n].decode(errors="replace")
            at += n
            made = one(head) if name == "swedish" else "".join(map(one, head))
            out.append(made)
            new.append((original, len(made.encode()) & 255))
        return "".join(out), new

    def normalize(self, segment: str, script: str, language: str | None) -> tuple[str, str, str | None, CharMap | None]:
        """lemma, kind, kind of separator, char map."""
        lemma, chars, kind = segment, None, ("word", None)
        for name, gate, one in self.steps(script, language):
            if name == "classify":
                kind = self.classify(lemma)
            elif gate(lemma):
                lemma, chars = self.apply(name, one, lemma, chars, self.config.create_char_map)
        return lemma, *kind, chars

    def by_character(self, script: str, language: str | None) -> Callable[[str], tuple[str, str, str | None, None] | None] | None:
        """normalize() by one look at each character, where all steps map characters one by one; None for a segment it can't tell."""
        steps = list(self.steps(script, language))
        names = [name for name, _, _ in steps]
        if self.config.create_char_map or self.config.normalizers or not {"swedish", "japanese", "greek"}.isdisjoint(names):
            return None
        if (tables_ := self.known_tables.get((script, language))) is None:
            at = names.index("classify")
            tables_ = self.known_tables[script, language] = _Characters(steps[:at]), _Characters(steps)
        before, whole = tables_

        def normalized(segment: str) -> tuple[str, str, str | None, None] | None:
            try:
                return segment.translate(whole), *self.classify(segment if segment.isascii() and segment.isprintable() else segment.translate(before)), None
            except _Unlike:
                return None

        return normalized

    def memo(self, script: str, language: str | None) -> dict[str, tuple]:
        known = self.known.setdefault((script, language), {})
        if len(known) > MEMO:
            known.clear()
        return known

    def text(self, text: str) -> str:
        """All steps on a whole string, no gate asked."""
        out = text if text.isascii() else _BEYOND_ASCII.sub(lambda m: nfkd(m[0]), text)
        if "\u0308" in out or "\u030a" in out:
            out = recompose_swedish(out)
        out = _CONTROL.sub("", out)
        if not self.config.lossy:
            return _BEYOND_ASCII.sub(lambda m: PERSIAN.get(m[0], m[0]), out)
        # the tables from here on leave ASCII alone, but for small letters and variants given for it
        out = "".join(map(str.lower, out)) if "Σ" in out else out.lower()
        if any(c.isascii() for c in (*self.variants, *self.pinyin)):
            out = "".join(map(self._changed, out))
        elif not out.isascii():
            out = _BEYOND_ASCII.sub(lambda m: self._changed(m[0]), out)
        out = to_hiragana(out)
        out = out[:-1] + "σ" if out.endswith("ς") else out
        return out if out.isascii() else _BEYOND_ASCII.sub(lambda m: _last(m[0]), out)

    def _changed(self, c: str) -> str:
        """A small letter through the tables before the step for kana."""
        if (made := self.known_changes.get(c)) is None:
            low = "".join(map(str.lower, PERSIAN.get(c, c)))
            made = self.known_changes[c] = "".join(self.chinese(x) for y in low for x in AE_OE.get(QUOTES.get(y, y), QUOTES.get(y, y)))
        return made


@cache
def _last(c: str) -> str:
    """A character through the tables after the step for kana."""
    return "".join(TURKISH.get(d, d) for x in ARABIC.get(c, c) if unicodedata.category(x) != "Mn" for d in VIETNAMESE.get(x, x))


# -- the whole --------------------------------------------------------------

#: Kinds of tokens and of separators, numbered.
KINDS: list[tuple[str, str | None]] = [("word", None), ("stop_word", None), ("separator", "soft"), ("separator", "hard")]
_KIND_NUMBER = {kind: k for k, kind in enumerate(KINDS)}

_NUMBER = cache(lambda c: c in _PUNCT or unicodedata.category(c)[0] == "N")


def maybe_number(text: str) -> bool:
    """Numbers and ASCII punctuation only: no segmenter is asked."""
    return all(map(_NUMBER, text))


class Engine:
    """Groups, splits, segments and normalises texts by one configuration."""

    def __init__(self, config: TokenizerConfig) -> None:
        self.config = config
        self.normalizer = Normalizer(config)
        self.groups_of = re.compile(tables.group_pattern(python=True)).findall
        self.mixed = re.compile(f"[{tables.char_class(tuple(r for s in tables.SCRIPT_RANGES if s != 'Latin' for r in tables.exclusive_ranges(s)), True)}]").search
        self.latin = re.compile(f"[{tables.char_class(tables.exclusive_ranges('Latin'), True)}]").search
        words = {w for w in config.words_dict or () if w}
        own = {w for w in config.separators or () if w}
        self.default_split = re.compile(tables.split_pattern(python=True)).findall
        self.ascii_split = re.compile(tables.split_pattern(tables.ascii_only(tables.separator_ranges()), python=True)).findall
        self.matches: frozenset[str] = tables.separators()
        self.custom = None
        if not config.default_split:
            self.matches = frozenset(words | (own or tables.separators()))
            parts = [tables.alternation(frozenset(x for x in self.matches if len(x) > 1 or own or x in words))]
            if not own:
                parts.append(f"[{tables.char_class(tables.separator_ranges(), True)}]")
            self.custom = re.compile("|".join(filter(None, parts)), re.S)
        self.registry: dict[tuple[str, str | None], str | Callable] = {**REGISTRY, **{(s, k): cut for s, k, cut in config.segmenters}}
        self.number_of_segmenters = {s: sum(k[0] == s for k in self.registry) for s in tables.SCRIPTS}

    def groups(self, text: str) -> list[str]:
        if not text:
            return []
        return self.groups_of(text) if self.mixed(text) else [text]

    def detect(self, group: str) -> str:
        if not self.mixed(group) and not _ARMENIAN.search(group):
            return "Latin" if self.latin(group) else "Other"
        return detect_script(group)

    def split(self, group: str) -> list[str]:
        if self.custom is None:
            return self.ascii_split(group) if group.isascii() else self.default_split(group)
        out, at = [], 0
        for m in self.custom.finditer(group):
            if m.start() > at:
                out.append(group[at : m.start()])
            out.append(m[0])
            at = m.end()
        if at < len(group):
            out.append(group[at:])
        return out

    def plan(self, group: str, script: str | None = None) -> tuple[str, str | None, str | Callable]:
        """Script (detected unless given), language (None unless it had to be known) and segmenter of a group."""
        script, language = script or self.detect(group), None
        n = self.number_of_segmenters[script]
        if n == 0:
            return script, None, "latin"
        if n == 1:
            return script, None, next(v for k, v in self.registry.items() if k[0] == script)
        language = language_for(group, script, self.config)
        return script, language, self.registry.get((script, language)) or self.registry.get((script, None)) or "latin"

    def segments(self, text: str) -> Iterator[tuple[list[str], str, str | None]]:
        """Of each group its segments, script and language."""
        for group in self.groups(text):
            script, language, name = self.plan(group)
            parts = self.split(group)
            if name != "latin" or self.config.camel_case:
                cut, matches = segmenter(name, self.config), self.matches
                parts = [s for p in parts for s in ([p] if p in matches or maybe_number(p) else cut(p))]
            yield parts, script, language

    def facts(self, parts: list[str], script: str, language: str | None) -> list[tuple[str, int, CharMap | None]]:
        """Of each segment of one group: lemma, number of its kind in KINDS, char map."""
        known = self.normalizer.memo(script, language)
        try:
            return list(map(known.__getitem__, parts))
        except KeyError:
            long: dict[str, tuple] = {}
            by_character = self.normalizer.by_character(script, language)
            for p in set(parts).difference(known):
                if by_character and (fact := by_character(p)):
                    lemma, kind, hard, chars = fact
                else:
                    lemma, kind, hard, chars = self.normalizer.normalize(p, script, language)
                (known if len(p) < 64 else long)[p] = lemma, _KIND_NUMBER[kind, hard], chars
            return [known[p] if p in known else long[p] for p in parts]

    def tokens(self, text: str) -> Iterator[tuple[str, str, str | None, tuple[str, str, str | None, CharMap | None]]]:
        """segment, script, language, (lemma, kind, kind of separator, char map)."""
        for parts, script, language in self.segments(text):
            for p, (lemma, kind, chars) in zip(parts, self.facts(parts, script, language), strict=True):
                yield p, script, language, (lemma, *KINDS[kind], chars)


@lru_cache(maxsize=16)
def engine(config: TokenizerConfig) -> Engine:
    return Engine(config)
