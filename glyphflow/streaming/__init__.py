"""The tokenizer on streams: stateless, and windowed counts of terms with a watermark."""

from .terms import run_to_table, shared_path, term_counts, tokenize_stream

__all__ = ["run_to_table", "shared_path", "term_counts", "tokenize_stream"]
