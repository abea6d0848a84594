"""The tokenizer as columns and as DataFrame operators.

Texts are handled batch by batch in Python and given back as Arrow arrays built
column by column, so no token becomes a row or an object of its own.  No shuffle:
a text is tokenized where it is read.  Batches are cut by size, so long texts
bound the memory of a worker, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cache, cached_property, partial
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import core, schema, tables
from ..config import TokenizerBuilder, TokenizerConfig

#: Bytes of text whose tokens are held at once.
PIECE = 1 << 20

#: Words over which counts are summed before they leave the worker.
SPAN = 1 << 22


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so much together; one range at least."""
    total = np.cumsum(sizes)
    begin, n = 0, len(total)
    while True:
        end = min(n, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most)) + 1)
        yield begin, end
        begin = end
        if begin >= n:
            return


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """Only the texts of one piece are Python strings at a time."""
    for begin, end in _cuts(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), PIECE):
        yield texts.slice(begin, end - begin).to_pylist()


def _list(counts: list[int | None], values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([n or 0 for n in counts])]).astype(np.int32)
    nulls = pa.array([n is None for n in counts] or [], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=nulls) if len(counts) else pa.array([], pa.list_(values.type))


# -- tokens of a piece


@cache
def _is_in(kind: str) -> np.ndarray:
    """By code point whether it is a default separator, Latin, a control character, or of a script that takes more than splitting."""
    if kind == "separator":
        ranges = tables.separator_ranges()
    elif kind == "latin":
        ranges = tables.exclusive_ranges("Latin")
    elif kind == "control":
        ranges = ((0, 0x1F), (0x7F, 0x9F))
    else:
        ranges = ((0x530, 0x58F), *(r for s in tables.SCRIPT_RANGES if s != "Latin" for r in tables.exclusive_ranges(s)))
    out = np.zeros(0x110000, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


class _Run(NamedTuple):
    """Consecutive segments of one script and language; their number in each of the texts that they make up."""

    counts: np.ndarray
    values: pa.Array
    controlled: np.ndarray  # segments with a control character
    script: str
    language: str | None


def _split(points: np.ndarray, joined: bytes, begins: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts set end to end, split by the default rules: how many segments each has, the segments, and which have control characters."""
    separator = _is_in("separator")[points]
    starts = separator.copy()
    starts[1:] |= separator[:-1]
    starts[1:] &= ~(((points[:-1] == 0x2E) | (points[:-1] == 0x2C)) & (points[1:] == 0x20))
    starts[begins[:-1][begins[:-1] < begins[1:]]] = True
    at = np.append(np.flatnonzero(starts), len(points))
    counts = np.diff(np.searchsorted(at, begins))
    controlled = np.searchsorted(at, np.flatnonzero(_is_in("control")[points]), "right") - 1
    if len(joined) > len(points):
        widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[at]
    return counts, pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(joined)), controlled


def _runs(engine: core.Engine, texts: list[str]) -> Iterator[_Run | list[tuple[list[str], str, str | None]]]:
    """Texts that only have to be split are split together; of any other the groups, one text at a time."""
    if engine.custom is not None or engine.config.camel_case:
        yield from (list(engine.segments(t)) for t in texts)
        return
    joined = "".join(texts)
    points = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def any_in(kind: str) -> list[bool]:
        total = np.concatenate([[0], np.cumsum(_is_in(kind)[points], dtype=np.int64)])[begins]
        return (total[1:] > total[:-1]).tolist()

    keys: list[tuple | None] = []
    for t, more, latin in zip(texts, any_in("more"), any_in("latin"), strict=True):
        script, language, name = ("", None, "") if more else engine.plan(t, "Latin" if latin else "Other")
        keys.append((script, language) if name == "latin" else None)
    at = 0
    while at < len(texts):
        end = at + 1
        if keys[at] is None:
            yield list(engine.segments(texts[at]))
        else:
            while end < len(texts) and keys[end] == keys[at]:
                end += 1
            a, b = begins[at], begins[end]
            yield _Run(*_split(points[a:b], joined[a:b].encode(), begins[at : end + 1] - a), *keys[at])
        at = end


def _strings(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    there: list[int] = []
    values: list[pa.Array] = []
    flat: list[str] = []  # of texts one by one, since the last that were split together
    for run in _runs(engine, [t for t in texts if t is not None]):
        if isinstance(run, _Run):
            there += run.counts.tolist()
            values += [pa.array(flat, pa.string()), run.values]
            flat = []
        else:
            before = len(flat)
            for parts, _, _ in run:
                flat += parts
            there.append(len(flat) - before)
    return _list(_with_nulls(texts, there), pa.concat_arrays([*values, pa.array(flat, pa.string())]))


def _with_nulls(texts: list[str | None], there: list[int]) -> list[int | None]:
    following = iter(there)
    return [None if t is None else next(following) for t in texts]


class _Coded:
    """Tokens of a piece as codes into a table of its distinct segments by script and language.

    What is known of a segment is looked up once for all of its tokens, which are then taken from the table;
    words of ASCII never become Python strings.
    """

    def __init__(self, engine: core.Engine, texts: list[str | None]) -> None:
        self.engine = engine
        #: script, language, distinct segments, and which of them have control characters (None: unknown)
        self.parts: list[tuple[str, str | None, pa.Array, np.ndarray | None]] = []
        own: dict[tuple[str, str | None], dict[str, int]] = {}
        there: list[int] = []
        codes: list[np.ndarray] = [np.empty(0, np.int32)]
        size = 0
        for run in _runs(engine, [t for t in texts if t is not None]):
            if isinstance(run, _Run):
                coded = run.values.dictionary_encode()
                at = coded.indices.to_numpy()
                self.parts.append((run.script, run.language, coded.dictionary, at[run.controlled]))
                codes.append(at + np.int32(size))
                size += len(coded.dictionary)
                there += run.counts.tolist()
                continue
            n = 0
            for parts, script, language in run:
                known = own.setdefault((script, language), {})
                if new := [p for p in dict.fromkeys(parts) if p not in known]:
                    known.update(zip(new, range(size, size + len(new)), strict=True))
                    self.parts.append((script, language, pa.array(new, pa.string()), None))
                    size += len(new)
                codes.append(np.array([known[p] for p in parts], np.int32))
                n += len(parts)
            there.append(n)
        self.counts = _with_nulls(texts, there)
        self.table = pa.concat_arrays([pa.array([], pa.string()), *(x[2] for x in self.parts)])
        self.codes = np.concatenate(codes)
        self.per_row = np.array(there, np.int64)
        self.row = np.repeat(np.arange(len(there)), self.per_row)

    @cached_property
    def facts(self) -> list[tuple]:
        return [f for script, language, table, _ in self.parts for f in self.engine.facts(table.to_pylist(), script, language)]

    def _plain(self, script: str, language: str | None, table: pa.Array, controlled: np.ndarray | None) -> np.ndarray:
        """Which of the segments are words of ASCII, of which only lower case may make something else."""
        if controlled is None or self.engine.normalizer.by_character(script, language) is None:
            return np.zeros(len(table), bool)
        size = pc.binary_length(table).to_numpy()
        plain = (size == pc.utf8_length(table).to_numpy()) & (size > 2)  # all shorter ones may be separators
        plain[controlled] = False
        if stops := self.engine.config.stop_words:
            plain &= ~pc.is_in(table, pa.array(list(stops), pa.string())).to_numpy(zero_copy_only=False)
        return plain

    @cached_property
    def normalized(self) -> tuple[pa.Array, np.ndarray]:
        """Of each row of the table its lemma and the number of its kind."""
        lemmas: list[pa.Array] = [pa.array([], pa.string())]
        kinds: list[np.ndarray] = [np.empty(0, np.int32)]
        for script, language, table, controlled in self.parts:
            plain = self._plain(script, language, table, controlled)
            rest, kind = np.flatnonzero(~plain), np.zeros(len(table), np.int32)
            facts = self.engine.facts(table.take(pa.array(rest)).to_pylist(), script, language)
            kind[rest] = [f[1] for f in facts]
            words = table.filter(pa.array(plain))
            if self.engine.config.lossy and script in core.CASED:
                words = pc.ascii_lower(words)
            order = np.empty(len(table), np.int32)
            order[plain], order[rest] = np.arange(len(words)), len(words) + np.arange(len(rest))
            lemmas.append(pa.concat_arrays([words, pa.array([f[0] for f in facts], pa.string())]).take(pa.array(order)))
            kinds.append(kind)
        return pa.concat_arrays(lemmas), np.concatenate(kinds)

    @cached_property
    def kinds(self) -> np.ndarray:
        """Of each token the number of its kind."""
        return self.normalized[1][self.codes]

    @cached_property
    def originals(self) -> pa.Array:
        return self.table.take(pa.array(self.codes))

    @cached_property
    def words(self) -> np.ndarray:
        return self.kinds == 0

    @cached_property
    def contexts(self) -> tuple[np.ndarray, int, np.ndarray]:
        """Of each word its context, numbered through all texts; how many there are, and of each text."""
        hard = self.kinds == core.KINDS.index(("separator", "hard"))
        per_row = np.bincount(self.row[hard], minlength=len(self.per_row)) + 1
        return (np.cumsum(hard) + self.row)[self.words], int(per_row.sum()), per_row


def _lemmas(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    t = _Coded(engine, texts)
    counts = np.bincount(t.row[t.words], minlength=len(t.per_row)).tolist()
    return _list(_with_nulls(texts, counts), t.normalized[0].take(pa.array(t.codes[t.words])))


def _contexts(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    """Of each text the lemmas of its words, listed by the hard separators between them."""
    t = _Coded(engine, texts)
    context, n, per_row = t.contexts
    lemmas = t.normalized[0].take(pa.array(t.codes[t.words]))
    return _list(_with_nulls(texts, per_row.tolist()), _list(np.bincount(context, minlength=n).tolist(), lemmas))


def _context_sizes(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    context, n, per_row = _Coded(engine, texts).contexts
    return _list(_with_nulls(texts, per_row.tolist()), pa.array(np.bincount(context, minlength=n).astype(np.int32)))


def _lemma_counts(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    t = _Coded(engine, texts)
    coded = t.normalized[0].dictionary_encode()
    found, n = np.unique(t.row[t.words] << 32 | coded.indices.to_numpy()[t.codes[t.words]], return_counts=True)
    counts = np.bincount(found >> 32, minlength=len(t.per_row)).tolist()
    lemmas = coded.dictionary.take(pa.array(found & 0xFFFFFFFF))
    return _list(_with_nulls(texts, counts), pa.StructArray.from_arrays([lemmas, pa.array(n.astype(np.int64))], names=["lemma", "n"]))


def _repeated(value: str, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int32)))


def _tokens(engine: core.Engine, texts: list[str | None], normalized: bool = True, original: bool = False, fields: Sequence[str] = ()) -> pa.Array:
    """fields: those of a token that are made; all, if empty."""
    t = _Coded(engine, texts)
    n = len(t.codes)

    def ends(name: str) -> pa.Array:
        size = (pc.utf8_length if name.startswith("char") else pc.binary_length)(t.table).to_numpy().astype(np.int64)[t.codes]
        total = np.concatenate([[0], np.cumsum(size)])
        last = total[1:] - total[np.cumsum(t.per_row) - t.per_row][t.row]
        return pa.array((last if name.endswith("end") else last - size).astype(np.int32))

    def char_map() -> pa.Array:
        if not (normalized and engine.config.create_char_map):
            return pa.nulls(n, schema.ARROW_CHAR_MAP)
        return _char_maps([f[2] for f in t.facts]).take(pa.array(t.codes))

    def key(i: int) -> pa.Array:
        number = np.repeat(np.arange(len(t.parts), dtype=np.int32), [len(part[2]) for part in t.parts])
        return pa.array([part[i] for part in t.parts], pa.string()).take(pa.array(number[t.codes]))

    make: dict[str, Callable[[], pa.Array]] = {
        "kind": lambda: _kind_names(t.kinds)[0] if normalized else _repeated("unknown", n),
        "separator_kind": lambda: _kind_names(t.kinds)[1] if normalized else pa.nulls(n, pa.string()),
        "lemma": lambda: t.normalized[0].take(pa.array(t.codes)) if normalized else t.originals,
        **{name: lambda name=name: ends(name) for name in ("char_start", "char_end", "byte_start", "byte_end")},
        "char_map": char_map,
        "script": lambda: key(0),
        "language": lambda: key(1),
    }
    names = list(fields or schema.TOKEN.fieldNames())
    token = pa.StructArray.from_arrays([make[name]() for name in names], names=names)
    if original:
        token = pa.StructArray.from_arrays([t.originals, token], names=["original", "token"])
    return _list(t.counts, token)


def _char_maps(maps: list[core.CharMap | None]) -> pa.Array:
    flat = [x for m in maps if m for x in m]
    pairs = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int16()), pa.array([b for _, b in flat], pa.int16())], names=["orig", "norm"])
    return _list([None if m is None else len(m) for m in maps], pairs)


def _kind_names(numbers: np.ndarray) -> list[pa.Array]:
    """Kinds and kinds of separators by number."""
    return [pa.array([k[i] for k in core.KINDS], pa.string()).take(pa.array(numbers)) for i in (0, 1)]


def _normalized(engine: core.Engine, rows: pa.ListArray) -> pa.Array:
    """Tokens with their lemmas normalised; each distinct lemma of a script and language once."""
    flat = rows.flatten()
    columns = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    coded = [columns[name].dictionary_encode(null_encoding="encode") for name in ("lemma", "script", "language")]
    number = np.zeros(len(flat), np.int64)
    for c in coded:
        number = number * max(1, len(c.dictionary)) + c.indices.to_numpy()
    found, first, at = np.unique(number, return_index=True, return_inverse=True)
    lemma, script, language = (columns[name].take(pa.array(first)).to_pylist() for name in ("lemma", "script", "language"))
    by_key: dict[tuple[str, str | None], list[int]] = {}
    for k, key in enumerate(zip(script, language, strict=True)):
        by_key.setdefault(key, []).append(k)
    facts: list[tuple] = [()] * len(found)
    for key, places in by_key.items():
        for k, fact in zip(places, engine.facts([lemma[k] for k in places], *key), strict=True):
            facts[k] = fact
    codes = pa.array(at.astype(np.int32))
    kinds, hard = _kind_names(np.array([f[1] for f in facts], np.int32)[at])
    unknown = pc.equal(columns["kind"], "unknown")
    columns["kind"] = pc.if_else(unknown, kinds, columns["kind"])
    columns["separator_kind"] = pc.if_else(unknown, hard, columns["separator_kind"])
    columns["lemma"] = pa.array([f[0] for f in facts], pa.string()).take(codes)
    columns["char_map"] = _char_maps([f[2] for f in facts]).take(codes) if engine.config.create_char_map else pa.nulls(len(flat), schema.ARROW_CHAR_MAP)
    token = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return _list(pc.list_value_length(rows).to_pylist(), token)


# -- counts over many texts

#: Of the words of a span and their contexts or texts: columns of lemmas' numbers that stand together, and how often they do.
Count = Callable[[np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray]]


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each stands there; sorts them in place."""
    numbers.sort()
    at = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)])
    return numbers[at], np.diff(at, append=len(numbers))


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each stands there; the first two columns as one number, then one more at a time."""
    if len(columns) == 1:
        found, n = _counted(columns[0])
        return [found], n
    if len(columns) == 2:
        found, n = _counted(columns[0].astype(np.int64) << 32 | columns[1])
        return [found >> 32, found & 0xFFFFFFFF], n
    number, rows = columns[0].astype(np.int64), [columns[0]]
    for k, c in enumerate(columns[1:], 2):
        found, *at, n = np.unique(number << 32 | c, return_inverse=k < len(columns), return_counts=True)
        first = found >> 32
        rows = [first if k == 2 else r[first] for r in rows] + [found & 0xFFFFFFFF]
        number = at[0].astype(np.int64) if at else found
    return rows, n


def _near(within: int) -> Count:
    def count(lemma: np.ndarray, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        pairs = []
        for d in range(1, within + 1):
            same = context[d:] == context[:-d]
            pairs.append(lemma[:-d][same].astype(np.int64))
            pairs[-1] <<= 32
            pairs[-1] |= lemma[d:][same]
        found, n = _counted(np.concatenate(pairs))
        return [(found >> 32).astype(np.int32), found.astype(np.int32)], n

    return count


def _grams(size: int) -> Count:
    def count(lemma: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        last = len(lemma) - size + 1
        if last <= 0:
            return [np.empty(0, np.int64)] * size, np.empty(0, np.int64)
        same = text[size - 1 :] == text[:last]
        return _distinct([lemma[k : k + last][same] for k in range(size)])

    return count


def _in_texts(lemma: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    found, n = _counted(_counted(text.astype(np.int64) << 32 | lemma)[0] & 0xFFFFFFFF)
    return [found], n


def _text(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    return pa.array([None if t is None else engine.normalizer.text(t) for t in texts], pa.string())


def _detected(engine: core.Engine, texts: list[str | None]) -> pa.Array:
    out = []
    for t in texts:
        if t is None:
            out.append(None)
        else:
            script = engine.detect(t)
            out.append({"script": script, "language": core.language_for(t, script, engine.config)})
    return pa.array(out, pa.struct([("script", pa.string()), ("language", pa.string())]))


DETECTED = T.StructType([T.StructField("script", T.StringType()), T.StructField("language", T.StringType())])

Kernel = Callable[[core.Engine, list[str | None]], pa.Array]


class Tokenizer:
    """All entry points of one configuration.

    Methods named after an operation take a column and give a column; transform()
    and explode() take a DataFrame.  Null texts give null, empty ones empty arrays.
    """

    def __init__(self, config: TokenizerConfig | None = None) -> None:
        self.config = config or TokenizerConfig()

    @staticmethod
    def builder() -> TokenizerBuilder:
        return TokenizerBuilder()

    def with_allow_list(self, allow_list: Iterable[str] | None) -> Tokenizer:
        from dataclasses import replace

        return Tokenizer(replace(self.config, allow_list=None if allow_list is None else tuple(allow_list)))

    # -- columns

    def _column(self, kernel: Kernel, kind: T.DataType, text: Column | str) -> Column:
        config = self.config

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            engine = core.engine(config)
            for b in batches:
                for part in _pieces(b):
                    yield kernel(engine, part)
                    pa.default_memory_pool().release_unused()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)(F.col(text) if isinstance(text, str) else text)

    def tokenize(self, text: Column | str, allow_list: Iterable[str] | None = None, fields: Sequence[str] = ()) -> Column:
        """array<token>: segmented, normalised, classified; with fields tokens have only these."""
        t = self if allow_list is None else self.with_allow_list(allow_list)
        return t._column(partial(_tokens, fields=tuple(fields)), schema.tokens(fields), text)

    def reconstruct(self, text: Column | str, fields: Sequence[str] = ()) -> Column:
        """array<struct<original, token>>."""
        return self._column(partial(_tokens, original=True, fields=tuple(fields)), schema.reconstructed(fields), text)

    def segment(self, text: Column | str, fields: Sequence[str] = ()) -> Column:
        """array<token> with raw lemmas and unknown kinds."""
        return self._column(partial(_tokens, normalized=False, fields=tuple(fields)), schema.tokens(fields), text)

    def segment_str(self, text: Column | str) -> Column:
        """array<string>."""
        return self._column(_strings, schema.STRINGS, text)

    def lemmas(self, text: Column | str) -> Column:
        """array<string>: the lemmas of word tokens, in order."""
        return self._column(_lemmas, schema.STRINGS, text)

    def contexts(self, text: Column | str) -> Column:
        """array<array<string>>: the lemmas of word tokens by context; a hard separator begins a new one."""
        return self._column(_contexts, T.ArrayType(schema.STRINGS, False), text)

    def context_sizes(self, text: Column | str) -> Column:
        """array<int>: how many words each of the contexts has."""
        return self._column(_context_sizes, T.ArrayType(T.IntegerType(), False), text)

    def lemma_counts(self, text: Column | str) -> Column:
        """array<struct<lemma, n>>: the text's distinct word lemmas and how often each stands in it."""
        return self._column(_lemma_counts, schema.COUNTS, text)

    def _summed(self, count: Count, text: Column | str, between: str | None = None, contexts: bool = False, most: int = SPAN) -> Column:
        """array<struct<key, n>>: counts over spans of texts or contexts, dealt out to the rows of the span in shares.

        key has the lemmas joined by between; without it, the length of the first in characters and a
        colon stand before them. Only sums over all rows mean something: what a worker meets again and
        again leaves it once a span.
        """
        config = self.config

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            engine = core.engine(config)
            tables_: list[pa.Array] = []
            span: list[tuple[np.ndarray, np.ndarray]] = []
            rows = words = within = size = 0

            def summed() -> Iterator[pa.Array]:
                coded = pa.concat_arrays(tables_).dictionary_encode()
                lemma, place = (np.concatenate(x) for x in zip(*span, strict=True))
                tables_.clear(), span.clear()
                # numbered in their order, as rows that begin alike take less room in a shuffle
                order = pc.array_sort_indices(coded.dictionary)
                rank = np.empty(len(order), np.int32)
                rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
                columns, n = count(rank[coded.indices.to_numpy()[lemma]], place)
                del lemma, place
                first = lemmas = coded.dictionary.take(order)
                if between is None and len(columns) > 1:
                    first = pc.binary_join_element_wise(pc.cast(pc.utf8_length(lemmas), pa.string()), lemmas, ":")
                shares = np.linspace(0, len(n), rows + 1).astype(np.int64)
                for begin, end in _cuts(np.diff(shares), 1 << 16):
                    a, b = shares[begin], shares[end]
                    told = [(lemmas if k else first).take(pa.array(c[a:b])) for k, c in enumerate(columns)]
                    key = pc.binary_join_element_wise(*told, between or "") if len(told) > 1 else told[0]
                    flat = pa.StructArray.from_arrays([key, pa.array(n[a:b].astype(np.int64))], names=["key", "n"])
                    yield _list(np.diff(shares[begin : end + 1]).tolist(), flat)

            for b in batches:
                for part in _pieces(b):
                    t = _Coded(engine, part)
                    place, n, _ = t.contexts if contexts else (t.row[t.words], len(part), None)
                    tables_.append(t.normalized[0])
                    span.append(((t.codes[t.words] + size).astype(np.int32), (place + within).astype(np.int32)))
                    words, within, rows, size = words + len(place), within + n, rows + len(part), size + len(t.table)
                    if words > most:
                        yield from summed()
                        pa.default_memory_pool().release_unused()
                        rows = words = within = size = 0
            if rows:
                yield from summed()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        kind = T.ArrayType(T.StructType([T.StructField("key", T.StringType(), False), T.StructField("n", T.LongType(), False)]), False)
        return F.arrow_udf(run, kind)(F.col(text) if isinstance(text, str) else text)

    def near_counts(self, text: Column | str, within: int) -> Column:
        """array<struct<key, n>>: pairs of words at most within apart in a context, summed as in _summed."""
        return self._summed(_near(within), text, contexts=True)

    def gram_counts(self, text: Column | str, size: int) -> Column:
        """array<struct<key, n>>: runs of so many words of a text, summed as in _summed."""
        return self._summed(_grams(size), text, " ")

    def text_counts(self, text: Column | str) -> Column:
        """array<struct<key, n>>: texts that have a word, summed as in _summed."""
        return self._summed(_in_texts, text)

    def normalize_text(self, text: Column | str) -> Column:
        """Every normaliser on the whole string, no gate asked."""
        return self._column(_text, T.StringType(), text)

    def detect(self, text: Column | str) -> Column:
        """struct<script, language>."""
        return self._column(_detected, DETECTED, text)

    def _each(self, texts: Column | str | Mapping[str, Column], names: Sequence[str], functions: Callable[[core.Engine], list[Callable[[str], object]]], listed: bool) -> Column:
        """struct<name, ...>: a function of each name, of one text or each of its own, in one pass of one worker."""
        config, own = self.config, isinstance(texts, Mapping)

        def made(f: Callable[[str], object], column: list[str | None]) -> pa.Array:
            got = [None if t is None else (f(t) if t or not listed else []) for t in column]
            if not listed:
                return pa.array(got, pa.string())
            return _list([None if g is None else len(g) for g in got], pa.array([p for g in got if g for p in g], pa.string()))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            made_of = functions(core.engine(config))
            for b in batches:
                columns = b.flatten() if own else [b]
                sizes = sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
                for begin, end in _cuts(sizes, PIECE):
                    part = [c.slice(begin, end - begin).to_pylist() for c in columns]
                    part = part if own else part * len(names)
                    yield pa.StructArray.from_arrays([made(f, c) for f, c in zip(made_of, part, strict=True)], names=list(names))
                    pa.default_memory_pool().release_unused()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        kind = schema.STRINGS if listed else T.StringType()
        column = F.struct(*(texts[n].alias(n) for n in names)) if own else F.col(texts) if isinstance(texts, str) else texts
        return F.arrow_udf(run, T.StructType([T.StructField(n, kind) for n in names]))(column)

    def segment_with(self, text: Column | str, segmenter: str) -> Column:
        """array<string>: one segmenter on the text, without detection and separators."""
        return self.segment_with_each(text, [segmenter])[segmenter]

    def segment_with_each(self, text: Column | str | Mapping[str, Column], segmenters: Iterable[str]) -> Column:
        """struct<name: array<string>, ...>: several segmenters on the text, or each on its own, in one pass."""
        names = list(segmenters)
        if unknown := set(names) - set(core.SEGMENTERS):
            raise ValueError(f"unknown segmenters {sorted(unknown)}")
        return self._each(text, names, lambda engine: [core.segmenter(n, engine.config) for n in names], True)

    def normalize_with(self, text: Column | str, normalizer: str, script: str = "Other", language: str | None = None, gated: bool = True) -> Column:
        """One normaliser on whole strings of one script and language; its gate is asked unless gated is false."""
        return self.normalize_with_each({normalizer: F.col(text) if isinstance(text, str) else text}, {normalizer: (script, language)}, gated)[normalizer]

    def normalize_with_each(self, texts: Mapping[str, Column], normalizers: Mapping[str, tuple[str, str | None]], gated: bool = True) -> Column:
        """struct<name: string, ...>: several normalisers, each on a text of its own of one script and language, in one pass."""
        asked = dict(normalizers)
        for name, (script, language) in asked.items():
            core.Normalizer(self.config).one(name, "", script, language, False)  # an unknown name fails here
        return self._each(texts, list(asked), lambda engine: [engine.normalizer.single(n, *of, gated) for n, of in asked.items()], False)

    def normalize_tokens(self, tokens: Column | str) -> Column:
        """array<token> from segment() -> array<token>, gates asked; offsets stay."""
        config = self.config

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            engine = core.engine(config)
            for b in batches:
                for begin, end in _cuts(pc.list_value_length(b).fill_null(0).to_numpy(zero_copy_only=False), PIECE >> 2):
                    yield _normalized(engine, b.slice(begin, end - begin))
                    pa.default_memory_pool().release_unused()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, schema.TOKENS)(F.col(tokens) if isinstance(tokens, str) else tokens)

    # -- DataFrames

    def transform(self, df: DataFrame, text_col: str = "text", output: str = "tokens") -> DataFrame:
        return df.withColumn(output, self.tokenize(text_col))

    def explode(self, df: DataFrame, text_col: str = "text", fields: Sequence[str] = ()) -> DataFrame:
        """One row a token: the other columns, pos, and the token's fields (or those named)."""
        # the generator takes the function itself: over a column, a filter on it would be inferred, and the function run twice
        rows = df.select(*[c for c in df.columns if c != text_col], F.posexplode(self.tokenize(text_col, fields=fields)).alias("pos", "_t"))
        return rows.select("*", "_t.*").drop("_t")


def spans(text: str, config: TokenizerConfig | None = None) -> list[tuple[str, int, int]]:
    """(segment, start, end) of one text, for trying things out on the driver."""
    parts = [p for s, _, _ in core.engine(config or TokenizerConfig()).segments(text) for p in s]
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    return [(p, a, b) for p, (a, b) in zip(parts, pairwise(ends), strict=True)]
