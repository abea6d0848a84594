"""Steps of the tokenizer as Catalyst expressions (Column -> Column)."""

from .columns import *  # noqa: F403
