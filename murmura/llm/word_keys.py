"""Hashes of the words of whole texts, taken from their bytes at once.

No Python word is made or kept, so a worker's memory does not follow the number of different words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

TEXTS = 1 << 19
"""Bytes of text that callers hash together."""
LONG = 64
"""Bytes of a word from which it is hashed on its own."""
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LETTERS = np.random.default_rng(9).integers(1, 2**64, 256, np.uint64)
"""A number for each byte; capital and small letters of A-Z share one."""
LETTERS[ord("A"):ord("Z") + 1] = LETTERS[ord("a"):ord("z") + 1]
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
END = b"\n"
"""No word holds a blank, so this stands for the end of a text."""
END_KEY = np.uint64(xxhash.xxh64_intdigest(END))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and FACTOR ** -i for i < size, in 64 bits."""
    back = np.uint64(pow(int(FACTOR), -1, 2**64))
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, f)]))
                 for f in (FACTOR, back))


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's words and of its end, one text after the other, and their numbers.

    A word is lower-cased in A-Z and ends at the six ASCII blanks. Its hash is a polynomial of its
    bytes' numbers, taken from sums over all bytes before; words of LONG bytes and more have one of their own.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[ends[0]:ends[-1]] if whole else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    # A word begins, and one ends, where blanks change or at a text's edge.
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(BLANK[data], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    edge[inner] = False
    first, last = solid[1:] & edge, solid[:-1] & edge
    first[inner], last[inner] = solid[1:][inner], solid[:-1][inner]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(max(TEXTS + 1, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[:len(data)], out=sums[1:])
    keys = mixed((sums[last] - sums[first]) * down[first])
    for i in np.flatnonzero(last - first >= LONG).tolist():
        keys[i] = xxhash.xxh64_intdigest(data[first[i]:last[i]].tobytes().lower())
    sizes = np.diff(np.searchsorted(first, ends)) + 1
    out = np.full(len(keys) + len(sizes), END_KEY)
    out[np.arange(len(keys)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = keys
    return out, sizes


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)
