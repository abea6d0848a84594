"""What a tokenizer is made from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from . import tables

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TokenizerConfig:
    """separators: None for the default list; an empty one still splits by default but classifies nothing.

    lexicons: words by segmenter ("thai", "khmer", "german", "chinese", "japanese", "korean");
    None for the small ones that come along.  kvariants: pairs (variant, standard).
    """

    stop_words: frozenset[str] = frozenset()
    separators: tuple[str, ...] | None = None
    words_dict: tuple[str, ...] | None = None
    allow_list: tuple[str, ...] | None = None
    create_char_map: bool = False
    lossy: bool = True
    camel_case: bool = False
    pinyin: tuple[tuple[str, str], ...] = ()
    kvariants: tuple[tuple[str, str], ...] | None = None
    lexicons: tuple[tuple[str, tuple[str, ...]], ...] = ()
    language_model: object | None = None
    #: characters that a lexicon segmenter hands on together at most where no word begins, by name
    buffers: tuple[tuple[str, int | None], ...] = ()
    #: (script, language or None, function text -> parts): beside or in place of the registered segmenters
    segmenters: tuple[tuple[str, str | None, Callable[[str], list[str]]], ...] = ()
    #: (name, gate(lemma, script, language), mapping of a character): after all other steps
    normalizers: tuple[tuple[str, Callable[[str, str, str | None], bool], Callable[[str], str]], ...] = ()

    def __post_init__(self) -> None:
        for code in self.allow_list or ():
            if code not in tables.LANGUAGES:
                raise ValueError(f"unknown language {code!r}")

    @property
    def default_split(self) -> bool:
        """Whether texts are split by the default separators alone."""
        return not any(self.words_dict or ()) and not any(self.separators or ())


class TokenizerBuilder:
    """Builds a Tokenizer step by step; each setter returns the builder."""

    def __init__(self) -> None:
        self._config = TokenizerConfig()

    def _set(self, **changes: object) -> TokenizerBuilder:
        self._config = replace(self._config, **changes)
        return self

    def stop_words(self, words: Iterable[str] | DataFrame) -> TokenizerBuilder:
        """Words, or a table whose first column has them (of a dictionary's size; functions.mark_stop_words joins larger ones)."""
        if hasattr(words, "toLocalIterator"):
            from .sources import read_words

            words = read_words(words)
        return self._set(stop_words=frozenset(words))

    def separators(self, separators: Iterable[str]) -> TokenizerBuilder:
        return self._set(separators=tuple(separators))

    def words_dict(self, words: Iterable[str]) -> TokenizerBuilder:
        return self._set(words_dict=tuple(words))

    def create_char_map(self, create: bool = True) -> TokenizerBuilder:
        return self._set(create_char_map=create)

    def lossy_normalization(self, lossy: bool) -> TokenizerBuilder:
        return self._set(lossy=lossy)

    def allow_list(self, languages: Iterable[str]) -> TokenizerBuilder:
        return self._set(allow_list=tuple(languages))

    def camel_case(self, split: bool = True) -> TokenizerBuilder:
        return self._set(camel_case=split)

    def lexicon(self, segmenter: str, words: Iterable[str]) -> TokenizerBuilder:
        rest = tuple(x for x in self._config.lexicons if x[0] != segmenter)
        return self._set(lexicons=(*rest, (segmenter, tuple(words))))

    def buffer(self, segmenter: str, characters: int | None) -> TokenizerBuilder:
        """Characters between a lexicon's words that come together at most; None for however many."""
        rest = tuple(x for x in self._config.buffers if x[0] != segmenter)
        return self._set(buffers=(*rest, (segmenter, characters)))

    def segmenter(self, script: str, language: str | None, cut: Callable[[str], list[str]]) -> TokenizerBuilder:
        """Adds a segmenter for a script and language, or takes the place of one; its parts joined have to be the text."""
        if script not in tables.SCRIPTS or (language is not None and language not in tables.LANGUAGES):
            raise ValueError(f"unknown script or language {script!r}, {language!r}")
        return self._set(segmenters=(*self._config.segmenters, (script, language, cut)))

    def normalizer(self, name: str, gate: Callable[[str, str, str | None], bool], one: Callable[[str], str]) -> TokenizerBuilder:
        """Adds a step after all others: one maps a character wherever gate(lemma, script, language) holds."""
        return self._set(normalizers=(*self._config.normalizers, (name, gate, one)))

    def kvariants(self, pairs: Iterable[tuple[str, str]]) -> TokenizerBuilder:
        return self._set(kvariants=tuple(pairs))

    def pinyin(self, pairs: Iterable[tuple[str, str]]) -> TokenizerBuilder:
        return self._set(pinyin=tuple(pairs))

    def language_model(self, model: object) -> TokenizerBuilder:
        return self._set(language_model=model)

    def config(self) -> TokenizerConfig:
        return self._config

    def build(self):
        from .operators.tokenizer import Tokenizer

        return Tokenizer(self._config)

    into_tokenizer = build
