"""Whole texts to token ids with the tokenizers library, each different word once per worker.

``word_bpe_49k`` drops blanks before it splits a text, and none of its patterns, nor its
normalizer, looks across a blank. The ids of a text are therefore the ids of its blank-free
pieces, one after the other. A worker keeps the ids of the pieces it has seen lately, so the
library sees every different word and not every word.
"""

from __future__ import annotations

import re
import string
import sys
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

KEEP = 400_000
"""Pieces of a generation of a worker's memory; two generations are kept."""
LONGEST_KEPT = 64
"""Characters of the longest piece that is kept; longer ones are encoded each time."""
STOPS = ",."
MARKS = "".join(c for c in string.punctuation if c not in "<|>")
"""Marks that part from a letter before them at a piece's end; ``<|>`` may end a special token."""
LATIN_WORD = re.compile("( ?)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
"""Letters of one case pair each, all composed: one word for every split pattern."""


def byte_alphabet() -> dict[int, int]:
    """Byte-level letters to bytes: printable bytes stand for themselves, the rest for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {c: c for c in plain} | {256 + i: b for i, b in enumerate(other)}


class Recent(dict):
    """A dict that fills itself and forgets: when it is full it becomes the older generation.

    What is still used moves back from the older generation, so common pieces stay.
    """

    def __init__(self, keep: int = KEEP):
        super().__init__()
        self.older: dict = {}
        self.keep = keep

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        return self.remember(key, self.make(key) if value is None else value)

    def remember(self, key: str, value: bytes) -> bytes:
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def word_and_stops(piece: str, marks: str = STOPS) -> int:
    """Where trailing marks (commas and full stops) begin if they follow a Latin letter, else 0.

    Every split pattern of these tokenizers parts a letter from such a mark, and no character
    of theirs combines with it, so both sides may be encoded on their own.
    """
    bare = len(piece.rstrip(marks))
    return bare if 0 < bare < len(piece) and piece[bare - 1] < "\u0100" \
        and piece[bare - 1].isalpha() else 0


def word_tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers as they are written."""
    values = array("I", ids)
    if values.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, "<u4").tobytes()
    return values.tobytes()


class Pieces(Recent):
    """Piece -> ids as little-endian unsigned 32-bit integers.

    A word with capitals or with marks after it is made from the plain word's ids, and kept
    itself only if the plain word was seen before, so rare words are held once.
    """

    def __init__(self, path: str, keep: int = KEEP):
        super().__init__(keep)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = {b: chr(c) for c, b in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        if piece in self.older or piece.isascii() and piece.isalpha() and piece.islower():
            return super().__missing__(piece)
        bare = word_and_stops(piece, MARKS)
        # Lower case as by the tokenizer's normalizer.
        word = piece[:bare] if bare else piece.lower() if LATIN_WORD.fullmatch(piece) else piece
        if word == piece:
            return super().__missing__(piece)
        seen = word in self
        value = self[word] + self[piece[bare:]] if bare else self[word]
        return self.remember(piece, value) if seen else value

    def make(self, piece: str) -> bytes:
        """Ids of a lower-case Latin word or of any piece without marks at its end."""
        if LATIN_WORD.fullmatch(piece):
            if not piece.isascii():
                piece = "".join(map(self.letters.__getitem__, piece.encode()))
            # One word for the split pattern: the library's model may take it at once.
            ids = [t.id for t in self.model.tokenize(piece)]
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return little_endian(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return b""
        blank = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, blank.split(" ")))


@lru_cache(maxsize=2)
def pieces(path: str, keep: int = KEEP) -> Pieces:
    """One per worker process and tokenizer file."""
    return Pieces(path, keep)
