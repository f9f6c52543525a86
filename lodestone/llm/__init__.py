"""Operators of a training-data pipeline over documents, pages and benchmarks.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations


def tokenizers_at(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
