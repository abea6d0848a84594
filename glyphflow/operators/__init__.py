"""Operators that run the tokenizer in Arrow batches, and relational analytics over their output."""
