"""BPE as a deterministic automaton over tokens, built merge by merge.

Construction. The automaton starts with one state and a loop for every byte. A merge (u, v)
adds its gadget: with q the state that u-arcs lead to, if q has a v-arc then every state with a
u-arc gets an arc uv to where v leads, and u-arcs are led to a new state: q's copy without its
v-arc. After all merges the automaton accepts exactly the token sequences that BPE yields, so a
byte string has one path, whose labels are its tokens.

Table. In this construction all arcs with the same label lead to the same state, and a state's
arcs to older labels never change. So no arc lists are stored: a state is (label it was made
for, rank of the merge that made it), and whether it has an arc w follows from two rules, which
``follows`` applies until one settles it:
 - w is younger than the state: the arc is there if the arc to w's left part is there;
 - w is older: the arc is there unless it was cut from this label's states, or is missing in
   the state the label led to when it was made.
Answers are kept, which makes the transition table that words are run through.

Encoding. Text is pre-split as the tokenizer file says, and a word's bytes are run through the
transition table. Decoding joins the bytes of the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from murmura.llm.common import ROWS_OUT, table
from murmura.llm.encoding import KEEP, LATIN_WORD, Recent, byte_alphabet, word_and_stops

START = -1
CHUNK = re.compile(r"\s*\S+|\s+")
"""A run of blanks and the word after it: no pattern of a byte-level split crosses its bounds."""
UNSURE = re.compile("[\x1c-\x1f]")
"""Characters that count as blanks here but not for the library: such texts are split whole."""


class Automaton:
    """The compiled merges of one byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.text = {i: t.translate(letters).encode("latin-1") for t, i in vocabulary.items()}
        size = max(self.text) + 1
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.cuts: list[list[int]] = [[] for _ in range(size)]
        self.base = [(START, -1)] * size
        self.cut_rank: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()
        made = set()
        for rank, merge in enumerate(spec["model"]["merges"]):
            u, v = (vocabulary[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            label = vocabulary["".join(merge) if isinstance(merge, list) else merge.replace(" ", "")]
            if label in made:
                raise ValueError("two merges make the same token")
            made.add(label)
            self.add_gadget(rank, u, v, label)
        self.arcs: dict[int, bool] = {}
        self.tokens = {data: label for label, data in self.text.items()
                       if label not in self.dead and (label in made or len(data) == 1)}
        self.longest: dict[bytes, int] = {}
        for data in self.tokens:
            self.longest[data[:2]] = max(self.longest.get(data[:2], 1), len(data))

    def state(self, label: int) -> tuple[int, int]:
        """Where arcs of this label lead now: the newest state made for it, or its first one."""
        return (label, self.cuts[label][-1]) if self.cuts[label] else self.base[label]

    def add_gadget(self, rank: int, u: int, v: int, label: int) -> None:
        if u in self.dead or v in self.dead or not self.follows(self.state(u), v):
            self.dead.add(label)
            return
        self.born[label], self.left[label], self.right[label] = rank, u, v
        self.base[label] = self.state(v)
        self.cuts[u].append(rank)
        self.cut_rank[u, v] = rank

    def follows(self, state: tuple[int, int], label: int) -> bool:
        """Whether the state has an arc with this label."""
        owner, since = state
        while owner != START:
            born = self.born[label]
            if born >= since:
                label = self.left[label]
                continue
            cut = self.cut_rank.get((owner, label))
            if cut is not None and cut <= since:
                return False
            older = bisect_right(self.cuts[owner], born)
            owner, since = (owner, self.cuts[owner][older - 1]) if older else self.base[owner]
        return True

    def has_arc(self, previous: int, label: int) -> bool:
        """Table entry: whether an arc ``label`` leaves the state that ``previous`` leads to."""
        key = previous << 32 | label
        there = self.arcs.get(key)
        if there is None:
            if len(self.arcs) >= 4 * KEEP:
                self.arcs.clear()
            there = self.arcs[key] = self.follows(self.state(previous), label)
        return there

    def encode(self, word: bytes) -> list[int]:
        """Labels of the word's path.

        Only one path reads a given prefix, so a position has one state. Longer arcs are tried
        first; a position from which the end can't be reached is marked and never entered again.
        """
        size, tokens, longest = len(word), self.tokens, self.longest
        path: list[int] = []
        steps: list[tuple[int, int]] = []
        barred: set[int] = set()
        at, length = 0, min(size, longest.get(word[:2], 1))
        while at < size:
            while length:
                label = tokens.get(word[at:at + length])
                if label is not None and at + length not in barred and (
                        not path or self.has_arc(path[-1], label)):
                    break
                length -= 1
            if length:
                steps.append((at, length))
                path.append(label)
                at += length
                length = min(size - at, longest.get(word[at:at + 2], 1))
            else:
                barred.add(at)
                at, length = steps.pop()
                path.pop()
                length -= 1
        return path


class Coder(Recent):
    """Chunk of text -> ids as bytes; pre-splits as the tokenizer file says and fills itself."""

    def __init__(self, path: str):
        super().__init__()
        library = Tokenizer.from_file(path)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_alphabet()
        self.automaton = Automaton(path)
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special = special
        names = sorted(special, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.labels = self.automaton.text | {i: t.encode() for t, i in special.items()}

    def make(self, chunk: str) -> bytes:
        bare = word_and_stops(chunk)
        if bare:
            return self[chunk[:bare]] + self[chunk[bare:]]
        if LATIN_WORD.fullmatch(chunk):
            return np.array(self.automaton.encode(chunk.encode()), "<u4").tobytes()
        ids: list[int] = []
        for part in self.names.split(chunk) if self.names else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word, _ in self.split(part):
                    ids += self.automaton.encode(word.translate(self.letters).encode("latin-1"))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if UNSURE.search(text):
            return self[text]
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of the arc labels; broken UTF-8 becomes replacement characters."""
        labels = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.labels.__getitem__, labels)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One per worker process and tokenizer file."""
    return Coder(path)


def byte_tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None,
                     with_ids: bool = True) -> DataFrame:
    """Every document's ids and the text decoded from them, with digests of both.

    doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids and decoded.
    Defined results: null text counts as empty and has no ids; a null doc_id stays null; rows
    that repeat stay; an empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or byte_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                coded = [known.encode(t) for t in batch.column(1).to_pylist()]
                decoded = [known.decode(c) for c in coded]
                columns = {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(d.encode()).hexdigest() for d in decoded])}
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(c, "<i4") for c in coded],
                                              pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.record_batch(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(
        run, schema + ", ids array<int>, decoded string" * with_ids)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
