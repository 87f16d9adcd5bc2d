"""Readers and writers."""

from .basket_files import read_baskets, write_baskets
from .delimited import DATASET, invalid_counts, load_dataset, null_tokens, read_delimited, write_delimited

__all__ = [
    "DATASET",
    "invalid_counts",
    "load_dataset",
    "null_tokens",
    "read_baskets",
    "read_delimited",
    "write_baskets",
    "write_delimited",
]
