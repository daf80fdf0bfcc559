"""Helpers shared by the corpus operators: row keys, Arrow batches, word hashes, passages of bytes.

Words are the runs of bytes other than ASCII white space, which is what ``bytes.split()``
yields; lower-casing with ``bytes.lower()`` changes A-Z only. A null text is an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multiplier of the polynomial hash of a word's bytes and its inverse modulo 2**64 (fixed values).
PRIME = 0x9E3779B97F4A7C15
U64 = np.uint64


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def unused_prefix(df: DataFrame) -> str:
    """A prefix that no column has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that low bits depend on all bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in an array of bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word of ``text``, without a Python loop over words.

    The hash of bytes b0..bn is the sum of mix(b_i, i): each byte is mapped together with its
    place in the word to a random-looking value, and the values of a word add up.
    """
    if lower:
        text = text.lower()
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=U64)
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=U64)
    length = end - start
    # offset of each byte in its word; white space between words gets a value that no sum includes
    at = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), dtype=np.int64)
    first[start] = start
    np.maximum.accumulate(first, out=first)
    at -= first
    value = mix((at.astype(U64) << U64(8)) + data + U64(PRIME))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(value, out=total[1:])
    return mix(total[end] - total[start] + length.astype(U64) * U64(PRIME))
