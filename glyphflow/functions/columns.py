"""Column -> Column: what built-in functions can express, without Python on the executors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import core, lexicons, tables


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _class(ranges: tables.Ranges) -> str:
    return f"[{tables.char_class(ranges)}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- grouping and splitting


#: Below this are the characters of most Latin text; those of other scripts are above.
_COMMON = 0x250


def _quick(ranges: tables.Ranges) -> str:
    """A class that finds bytes in one table and other common characters before it walks through all ranges."""
    few = "".join(f"\\x{{{cp:X}}}" for lo, hi in ranges for cp in range(lo, min(hi, 0xFF) + 1))
    common = tables.char_class(tuple((max(lo, 0x100), min(hi, _COMMON - 1)) for lo, hi in ranges if hi >= 0x100 and lo < _COMMON))
    rest = tables.char_class(tuple((max(lo, _COMMON), hi) for lo, hi in ranges if hi >= _COMMON))
    parts = [f"[{x}]" for x in (few, common) if x] + [f"[\\x{{{_COMMON:X}}}-\\x{{10FFFF}}&&[{rest}]]"] * bool(rest)
    return f"[{''.join(parts)}]"


def _without(ranges: tables.Ranges, end: int = 0x110000) -> tables.Ranges:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if at < min(lo, end):
            out.append((at, min(lo, end) - 1))
        at = max(at, hi + 1)
    return (*out, (at, end - 1)) if at < end else tuple(out)


@cache
def _group_pattern() -> str:
    """tables.group_pattern() of quick classes."""
    others = tables.other_ranges()
    runs = "|".join(f"{_quick(own)}{_quick(tuple(sorted((*own, *others))))}*" for own in map(tables.exclusive_ranges, tables.SCRIPT_RANGES))
    return f"\\A{_quick(others)}+\\z|(?:\\A{_quick(others)}+)?(?:{runs})"


@cache
def _split_pattern() -> str:
    """tables.split_pattern() of quick classes: what is no separator first, as every separator of more characters begins with one."""
    separators = tables.separator_ranges()
    return f"{_quick(_without(separators))}+|\\. |, |\\x{{17D4}}\\x{{179B}}\\x{{17D4}}|{_quick(separators)}"


@cache
def _ascii_split_pattern() -> str:
    separators = tables.ascii_only(tables.separator_ranges())
    return f"{_quick(_without(separators, 0x80))}+|\\. |, |{_quick(separators)}"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def script_groups(text: Column | str) -> Column:
    """array<string>: maximal runs of one script."""
    return F.regexp_extract_all(_col(text), F.lit(_group_pattern()), F.lit(0))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_separators(text: Column | str) -> Column:
    """array<string>: default separators and what lies between; ASCII rows use a class of ASCII ranges."""
    text = _col(text)
    return F.when(_is_ascii(text), _all(text, _ascii_split_pattern())).otherwise(_all(text, _split_pattern()))


def segment_native(text: Column | str) -> Column:
    """array<string>: groups, then separators; equal to segment_str() where no dictionary segmenter is asked for."""
    text = _col(text)
    others = _quick(tuple(sorted(r for s in tables.SCRIPT_RANGES if s != "Latin" for r in tables.exclusive_ranges(s))))
    return (
        F.when(_is_ascii(text), _all(text, _ascii_split_pattern()))
        .when(text.rlike(others), F.flatten(F.transform(script_groups(text), split_separators)))
        .otherwise(_all(text, _split_pattern()))
    )


def split_custom(text: Column | str, words: Iterable[str]) -> Column:
    """array<string>: the longest of the words at each place, and the gaps; without words the default split."""
    words = tuple(w for w in words if w)
    if not words:
        return split_separators(text)
    text, pattern = _col(text), F.lit(tables.gap_pattern(words))
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("word"))
    return F.filter(F.flatten(F.transform(pairs, lambda x: F.array(x["gap"], x["word"]))), lambda p: p != "")


def maybe_number(part: Column | str) -> Column:
    """Numbers and ASCII punctuation only."""
    return _col(part).rlike(r"\A[\p{N}\p{Punct}]+\z")


def split_camel_case(part: Column | str) -> Column:
    return F.split(_col(part), r"(?<=\p{Ll}\p{Mn}{0,9})(?=\p{Lu})|(?<=(?s:.))(?=\p{Lu}\p{Ll})")


def split_arabic_article(part: Column | str) -> Column:
    part = _col(part)
    cut = F.array(F.substring(part, 1, 2), F.substring(part, F.lit(3), F.char_length(part)))
    return F.when((F.octet_length(part) > 4) & part.rlike(r"\A[اأإآٱ]ل"), cut).otherwise(F.array(part))


# -- detection


def contains_script(text: Column | str, name: str) -> Column:
    """Whether a character of a script, or of a part of one (Hiragana, Katakana, Mandarin, Persian), occurs."""
    return _col(text).rlike(_class(tables.SCRIPT_RANGES.get(name) or tables.PART_RANGES[name]))


def detector_language(code: Column | str) -> Column:
    """The code under which detectors know a language: zho is cmn."""
    code = _col(code)
    return F.when(code == "zho", "cmn").otherwise(code)


def detect_script(text: Column | str) -> Column:
    """The script with most characters; ties go to the script named first.

    Latin is counted by what its removal takes away; the other scripts are counted in
    what is left beyond U+024F, which is nothing in most Latin text, and there only
    those of which a character occurs.
    """
    latin = tables.char_class(tables.exclusive_ranges("Latin"))

    def best(t: Column, rest: Column, seen: Column) -> Column:
        counts = [F.struct((F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{latin}]+", ""))).alias("n"), F.lit(0).alias("k"), F.lit("Latin").alias("name"))]
        for k, s in enumerate(tables.SCRIPT_RANGES):
            if s != "Latin":
                c = tables.char_class(tables.exclusive_ranges(s))
                n = F.when(seen.rlike(f"[{c}]"), F.char_length(rest) - F.char_length(F.regexp_replace(rest, f"[{c}]+", ""))).otherwise(0)
                counts.append(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("name")))
        return F.array_max(F.array(*counts))

    def named(t: Column) -> Column:
        rest = F.regexp_replace(t, r"[\x00-\x{24F}]+", "")
        found = _let(rest, lambda r: _let(F.array_join(F.array_distinct(F.split(r, "")), ""), lambda seen: best(t, r, seen)))
        return _let(found, lambda b: F.when(b["n"] > 0, b["name"]).when(t.isNotNull(), F.lit("Other")))

    return _let(_col(text), named)


def language_from_code(code: Column | str) -> Column:
    code = _col(code)
    return F.when(code.isin(*tables.LANGUAGES), code)


def script_name(script: Column | str) -> Column:
    script = _col(script)
    return F.when(script == "Cj", "Mandarin").when(script == "Other", "other").otherwise(script)


def script_from_name(name: Column | str) -> Column:
    name = _col(name)
    named = [s for s in tables.SCRIPTS if s not in ("Cj", "Other")]
    return F.when(name == "Mandarin", "Cj").when(name.isin(*named), name).otherwise("Other")


# -- classification and token predicates


def is_separator_text(lemma: Column | str) -> Column:
    return _col(lemma).rlike(f"\\A(?:\\. |, |\\x{{17D4}}\\x{{179B}}\\x{{17D4}}|{_class(tables.separator_ranges())})\\z")


def is_hard_text(lemma: Column | str) -> Column:
    return _col(lemma).rlike(f"\\A(?:\\. |, |\\x{{17D4}}\\x{{179B}}\\x{{17D4}}|{_class(tables.HARD_RANGES)})\\z")


def classify(lemma: Column | str, stop_words: Iterable[str] = (), separators: Iterable[str] | None = None) -> Column:
    """struct<kind, separator_kind>; stop words come before separators."""
    lemma, stop = _col(lemma), list(stop_words)
    if separators is None:
        separator = is_separator_text(lemma)
    else:
        own = list(separators)
        separator = lemma.isin(*own) if own else F.lit(False)
    kind = F.when(separator, "separator").otherwise("word")
    kind = F.when(lemma.isin(*stop), "stop_word").otherwise(kind) if stop else kind
    hard = F.when(kind == "separator", F.when(is_hard_text(lemma), "hard").otherwise("soft"))
    return F.struct(kind.alias("kind"), hard.alias("separator_kind"))


def mark_stop_words(tokens: DataFrame, stop_words: DataFrame, lemma_col: str = "lemma", kind_col: str = "kind") -> DataFrame:
    """kind_col set to stop_word where the lemma is in stop_words (one column): a join, for lists of any size."""
    words = stop_words.select(F.col(stop_words.columns[0]).alias("_word")).distinct().withColumn("_stop", F.lit(True))
    return tokens.join(words, tokens[lemma_col] == words["_word"], "left").withColumn(kind_col, F.when(F.col("_stop"), "stop_word").otherwise(F.col(kind_col))).drop("_word", "_stop")


def map_variants(tokens: DataFrame, variants: DataFrame, lemma_col: str = "lemma") -> DataFrame:
    """lemma_col replaced where it is the first column of variants, by the second: a join, for tables of any size."""
    source, standard = variants.columns[:2]
    pairs = variants.groupBy(F.col(source).alias("_variant")).agg(F.min(standard).alias("_standard"))
    return tokens.join(pairs, tokens[lemma_col] == pairs["_variant"], "left").withColumn(lemma_col, F.coalesce("_standard", lemma_col)).drop("_variant", "_standard")


def is_word(token: Column) -> Column:
    return token["kind"] == "word"


def is_stopword(token: Column) -> Column:
    return token["kind"] == "stop_word"


def is_separator(token: Column) -> Column:
    return token["kind"] == "separator"


def separator_kind(token: Column) -> Column:
    return token["separator_kind"]


# -- measures


def byte_len(token: Column) -> Column:
    return F.octet_length(token["lemma"])


def original_byte_len(token: Column) -> Column:
    return token["byte_end"] - token["byte_start"]


def char_count(token: Column) -> Column:
    return F.char_length(token["lemma"])


def original_char_count(token: Column) -> Column:
    return token["char_end"] - token["char_start"]


def original_lengths(token: Column, num_bytes: Column | int) -> Column:
    """struct<chars, bytes> of the original that the first num_bytes of the lemma cover."""
    num = F.lit(num_bytes) if isinstance(num_bytes, int) else num_bytes
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes"), F.lit(0).alias("seen"))

    def step(acc: Column, orig: Column, norm: Column) -> Column:
        more = F.struct((acc["chars"] + 1).alias("chars"), (acc["bytes"] + orig).alias("bytes"), (acc["seen"] + norm).alias("seen"))
        return F.when(acc["seen"] < num, more).otherwise(acc)

    mapped = F.aggregate(token["char_map"], zero, lambda acc, x: step(acc, x["orig"].cast("int"), x["norm"].cast("int")))
    plain = F.aggregate(F.regexp_extract_all(token["lemma"], F.lit("(?s)."), F.lit(0)), zero, lambda acc, c: step(acc, F.octet_length(c), F.octet_length(c)))
    out = F.when(token["char_map"].isNotNull(), mapped).otherwise(plain)
    return F.struct(out["chars"].alias("chars"), out["bytes"].alias("bytes"))


#: How often the sums of four values each are summed in the same way; with n values, n / 4 ** LEVELS are summed by copying an array.
LEVELS = 9


def _running_sums(values: Column, levels: int = LEVELS) -> Column:
    """array<bigint>: running sums of an array<bigint> that is not null.

    A running sum in a row copies its array at each step, so the sums of four values each are
    summed first, which tells where each four begin. In the last four, places beyond the end are
    null and are cut off; what they sum to is never asked.
    """
    zero = F.lit(0).cast("bigint")
    if not levels:
        sums = F.aggregate(values, F.array(zero), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)))
        return F.slice(sums, F.lit(2), F.size(values))
    fours = F.sequence(F.lit(0), F.shiftright(F.size(values) - 1, 2))
    value = lambda i, k: F.get(values, F.shiftleft(i, 2) + k)

    def of(ends: Column) -> Column:
        def four(i: Column) -> Column:
            a = F.coalesce(F.get(ends, i - 1), zero) + value(i, 0)
            return F.array(a, a + value(i, 1), a + value(i, 1) + value(i, 2), a + value(i, 1) + value(i, 2) + value(i, 3))

        return F.slice(F.flatten(F.transform(fours, four)), F.lit(1), F.size(values))

    sums = F.transform(fours, lambda i: value(i, 0) + value(i, 1) + value(i, 2) + value(i, 3))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_let(_let(sums, lambda x: _running_sums(x, levels - 1)), of))


def with_offsets(segments: Column | str) -> Column:
    """array<struct<segment, char_start, char_end, byte_start, byte_end>> by running sums, of characters and bytes in one number."""

    def told(s: Column, end: Column) -> Column:
        c, b = F.shiftright(end, 32).cast("int"), end.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(s.alias("segment"), (c - F.char_length(s)).alias("char_start"), c.alias("char_end"), (b - F.octet_length(s)).alias("byte_start"), b.alias("byte_end"))

    def of(s: Column) -> Column:
        sizes = F.transform(s, lambda x: F.shiftleft(F.char_length(x).cast("bigint"), 32) + F.octet_length(x))
        return F.when(s.isNotNull(), F.zip_with(s, _let(sizes, lambda x: _running_sums(x)), told))

    return _let(_col(segments), of)


# -- normalisers that are tables


def _translated(text: Column, table: dict[str, str]) -> Column:
    """One character for one, or none; longer replacements one by one after that."""
    one = {a: b for a, b in table.items() if len(b) == 1}
    gone = "".join(a for a, b in table.items() if not b)
    text = F.translate(text, "".join(one) + gone, "".join(one.values()))
    return reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), ((a, b) for a, b in table.items() if len(b) > 1), text)


def strip_control(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]", "")


def normalize_quotes(text: Column | str) -> Column:
    return _translated(_col(text), core.QUOTES)


def normalize_ae_oe(text: Column | str) -> Column:
    return _translated(_col(text), core.AE_OE)


def normalize_vietnamese(text: Column | str) -> Column:
    return _translated(_col(text), core.VIETNAMESE)


def normalize_turkish(text: Column | str) -> Column:
    return _translated(_col(text), core.TURKISH)


def normalize_arabic(text: Column | str) -> Column:
    return _translated(_col(text), core.ARABIC)


def normalize_persian(text: Column | str) -> Column:
    return _translated(_col(text), core.PERSIAN)


def normalize_greek(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"ς\z", "σ")


def strip_marks(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\p{Mn}", "")


def recompose_swedish(text: Column | str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(unicodedata.normalize("NFD", c)), F.lit(c)), "ÅåÄäÖö", _col(text))


def normalize_kvariants(text: Column | str, pairs: Iterable[tuple[str, str]] | None = None) -> Column:
    pairs = [(a, b) for a, _, b in lexicons.KVARIANTS] if pairs is None else list(pairs)
    return F.translate(_col(text), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def katakana_to_hiragana(text: Column | str) -> Column:
    """Without the long-vowel mark, which depends on what stands before it."""
    kana = [chr(c) for c in range(0x30A1, 0x30F7)]
    return F.translate(_col(text), "".join(kana), "".join(chr(ord(c) - 0x60) for c in kana))


def lower_chars(text: Column | str) -> Column:
    """Lower case of each character by itself: a sigma never looks at its neighbours."""
    return F.lower(F.translate(_col(text), "Σ", "σ"))
