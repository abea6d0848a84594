"""Readers of texts, lexicons and variant tables; writers of tokens are Spark's own."""

from .readers import KVARIANT, kvariants_etl, read_kvariants, read_lexicon, read_stop_words, read_texts, read_words

__all__ = ["KVARIANT", "kvariants_etl", "read_kvariants", "read_lexicon", "read_stop_words", "read_texts", "read_words"]
