"""Exact substring deduplication by sorting suffixes bucket by bucket with a difference cover.

A byte is removed if a string of SPAN bytes that covers it starts earlier, too. So suffixes have
to stand in an order in which equal strings of SPAN bytes are neighbours; the earliest of each
group of neighbours stays, the windows at all others go.

Candidates. Every window of SPAN bytes holds the smallest hash of its strings of GRAM bytes. Equal
windows hold equal ones, so a window whose smallest hash occurs once in the whole corpus has no
partner, and its suffix needs no sorting. Windows that repeat within one batch of texts are
settled there, byte by byte, which keeps a string that half of all texts share from gathering in
one bucket. The bytes below the other windows are written as flat files that all tasks map.

Cover sample. COVER is a difference cover modulo PERIOD: for any two places there is a shift below
PERIOD that takes both to sampled places. The sampled suffixes are sorted first, by RANK_WORDS
words, and their ranks are written beside the text.

Buckets. Suffixes are dealt by their first bytes to buckets of about BUCKET, which tasks sort one
at a time: word by word for the first PERIOD bytes, and ties after those by the rank of a sampled
place that both suffixes reach within PERIOD. So a comparison never reads far ahead, and memory is
bounded by the bucket, however long the ties are.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import (binary_rows, input_bytes, map_array, save_array,
                                shared_folder_for, slices, table)
from murmura.runtime import materialize, scratch_path

SPAN, GRAM = 100, 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
"""Every difference modulo PERIOD occurs between two of these."""
DEEP = -(-PERIOD // 8)
"""Words compared before ties go to the ranks."""
RANK_WORDS = 13
"""Words of SPAN bytes and more, by which sampled suffixes are ranked."""
PAD = 512
"""Zero bytes after a flat text, so that every read ends inside it."""
BUCKET = 1_000_000
PER_BUCKET = 32
"""Places looked at for each bucket to choose its bounds."""
BOUND_WORDS = 3
PART_BYTES = 64 << 20
"""Text bytes whose smallest hashes one part holds."""
SEGMENT = 1 << 15
CHUNK = 1 << 20
"""Places of a flat text that are packed together, two bytes for each."""
TEXTS = 4 << 20
"""Bytes of text that a task looks at together."""
NO_ID = np.iinfo(np.int64).min
"""Stands for a null doc_id: it comes before all others."""

_random = np.random.default_rng(11)
BYTES = _random.integers(1, 2 ** 63, 256).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, np.uint64(base))
    found[0] = 1
    return np.multiply.accumulate(found)


POWERS = _powers(BASE, SEGMENT + 4 * SPAN)
INVERSE = _powers(pow(BASE, -1, 1 << 64), SEGMENT + 4 * SPAN)

# Shifts from each remainder to the sampled places of the next PERIOD bytes, and for two
# remainders which of them leads to the place that suits both.
SHIFTS = np.array([sorted((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
MEETING = np.array([[next(k for k, d in enumerate(SHIFTS[r]) if d in SHIFTS[q])
                     for q in range(PERIOD)] for r in range(PERIOD)])
PLACE = np.full(PERIOD, -1)
PLACE[list(COVER)] = np.arange(len(COVER))


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the string of ``size`` bytes at each place of at most a segment."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * POWERS[:len(data)], out=sums[1:])
    found = sums[size:] - sums[:-size]
    found *= INVERSE[:len(found)]
    return found


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[:len(values) - (width - have)], values[width - have:]) \
        if width > have else values


def window_minima(data: np.ndarray, valid: np.ndarray,
                  places: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of every valid window (else 0), and the hashes at the places taken."""
    width = SPAN - GRAM + 1
    minima, taken = np.zeros(len(data), np.uint64), []
    for at in range(0, len(data), SEGMENT):
        low, high = max(at - width + 1, 0), min(at + SEGMENT, len(data))
        grams = hashes(data[low:high + SPAN - 1], GRAM)
        if len(grams) < width:
            continue
        least = sliding(grams, width, np.minimum)
        least = np.where(valid[low:low + len(least)], least, np.uint64(0))
        minima[at:low + len(least)] = least[at - low:]
        if not places:
            continue
        # A place is taken if its hash is the smallest of some window that holds it.
        framed = np.zeros(len(grams) + width - 1, np.uint64)
        framed[width - 1:width - 1 + len(least)] = least
        most = sliding(framed, width, np.maximum)
        end = high - low if high < len(data) else len(grams)
        mine = slice(at - low, min(end, len(grams)))
        taken.append(grams[mine][grams[mine] == most[mine]])
    return minima, np.concatenate([np.zeros(0, np.uint64), *taken])


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, their bounds, and where a window lies inside one text."""
    parts = [(t or "").encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    valid = np.ones(len(data), bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        valid[max(a, b - SPAN + 1):b] = False
    return data, ends, valid


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a big-endian number, uncopied; the last 7 have none."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


# --- repeated hashes -------------------------------------------------------------

def repeated_hashes(docs: DataFrame, folder: str, parts: int) -> None:
    """Files of the window hashes that occur twice or more, one per range of hash values.

    Of a hash the part's number and the next 32 bits count. Two hashes taken for one make a
    candidate more, never less.
    """
    width = 1 << max(0, parts - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, TEXTS):
            data, _, valid = joined(batch.column(0).to_pylist())
            part, values, counts = parted(np.sort(window_minima(data, valid)[1]), width)
            bounds = np.searchsorted(part, np.arange(width + 1))
            some = [p for p in range(width) if bounds[p] < bounds[p + 1]]
            cut = [slice(bounds[p], bounds[p + 1]) for p in some]
            yield pa.record_batch([
                pa.array(some, pa.int64()), binary_rows([values[c][counts[c] == 1] for c in cut]),
                binary_rows([values[c][counts[c] > 1] for c in cut])], ["part", "once", "often"])

    def gather(rows: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(rows["once"].to_pylist()), np.uint32)
        often = np.frombuffer(b"".join(rows["often"].to_pylist()), np.uint32)
        values, counts = np.unique(np.concatenate([once, often, often]), return_counts=True)
        save_array(f"{folder}/hashes-{rows['part'][0].as_py()}", values[counts > 1])
        return pa.table({"n": pa.array([int((counts > 1).sum())], pa.int64())})

    (docs.select("text").mapInArrow(run, "part long, once binary, often binary")
     .groupBy("part").applyInArrow(gather, "n long").agg(F.sum("n")).collect())


def parted(sorted_hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes as part and 32 bits, and how often each occurs."""
    bits = np.uint64(width.bit_length() - 1)
    short = sorted_hashes >> (np.uint64(32) - bits)
    opens = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])[:len(short)])
    counts = np.diff(np.concatenate([opens, [len(short)]]))
    return (short[opens] >> np.uint64(32)).astype(np.int64), short[opens].astype(np.uint32), counts


def is_repeated(hashes_: np.ndarray, folder: str, parts: int) -> np.ndarray:
    """Which hashes are in the files; one look-up for all of a file's."""
    width = 1 << max(0, parts - 1).bit_length()
    order = np.argsort(hashes_)
    part, values, counts = parted(hashes_[order], width)
    found = np.zeros(len(values), bool)
    bounds = np.searchsorted(part, np.arange(width + 1))
    for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
        known = map_array(f"{folder}/hashes-{p}", np.uint32)
        if a < b and len(known):
            at = np.minimum(np.searchsorted(known, values[a:b]), len(known) - 1)
            found[a:b] = known[at] == values[a:b]
    back = np.empty(len(hashes_), bool)
    back[order] = np.repeat(found, counts)
    return back


# --- candidate text ----------------------------------------------------------------

def repeats_in_batch(data: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of some windows equal an earlier one of the batch; ``rank`` orders the windows."""
    found = np.zeros(len(places), bool)
    if not len(places):
        return found
    keys = np.empty(len(places), np.uint64)
    for at in range(0, len(data), SEGMENT):
        a, b = np.searchsorted(places, [at, at + SEGMENT])
        if a < b:
            keys[a:b] = hashes(data[at:at + SEGMENT + SPAN - 1], SPAN)[places[a:b] - at]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return found
    some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
    keys = keys[some]
    order = np.lexsort((rank[some], keys))
    opens = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    first = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    again, held = some[order[~opens]], some[first[~opens]]
    same = np.ones(len(again), bool)
    words = words_at(data)
    for shift in [*range(0, SPAN - 8, 8), SPAN - 8]:
        same &= words[places[again] + shift] == words[places[held] + shift]
    found[again[same]] = True
    return found


def windows_below(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes below windows as stretches, cut where a document of bounds ``ends`` stops."""
    if not len(starts):
        return starts, starts
    doc = np.searchsorted(ends, starts, "right")
    opens = np.concatenate([[True], (np.diff(starts) > SPAN) | (doc[1:] != doc[:-1])])
    return starts[opens], starts[np.concatenate([opens[1:], [True]])] + SPAN


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covered(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Flags of the bytes in some stretches."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, last, -1)
    return np.cumsum(marks[:-1]) > 0


def candidate_text(docs: DataFrame, folder: str, parts: int) -> DataFrame:
    """A written table of all documents; flat files of the bytes that must be sorted.

    Per task f: ``text-f``; ``heads-f``, bits of the places whose suffixes are to be sorted; and
    per piece of a document ``start-f`` (in the file), ``row-f``, ``id-f`` and ``from-f`` (in the
    document). Columns: row, doc_id, file, n_bytes, rest (the bytes outside of pieces, where a
    verdict is open), plain where none is (the digest of the whole text), settled (stretches that
    go already).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = TaskContext.get().partitionId(), 0
        draft = f"{folder}/text-{name}.{uuid.uuid4().hex}"
        kept: list[list] = [[], [], [], [], []]
        with open(draft, "wb") as out:
            for batch in slices(batches, 2, TEXTS):
                texts = batch.column(2).to_pylist()
                ids = batch.column(1).fill_null(NO_ID).to_numpy()
                rows = batch.column(0).to_numpy()
                data, ends, valid = joined(texts)
                minima, _ = window_minima(data, valid, False)
                opens = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]])
                                       [:len(minima)])
                candidate = np.repeat(is_repeated(minima[opens], folder, parts),
                                      np.diff(np.concatenate([opens, [len(minima)]])))
                places = np.flatnonzero(candidate & valid)
                doc = np.searchsorted(ends, places, "right") - 1
                # Texts in order of doc_id, then row; inside a text by place.
                rank = np.empty(len(texts), np.int64)
                rank[np.lexsort((rows, ids))] = np.arange(len(texts))
                again = repeats_in_batch(data, places, rank[doc] * (len(data) + 1) + places)
                heads = places[~again]
                first, last = windows_below(heads, ends)
                own = np.searchsorted(ends, first, "right") - 1
                into = size + np.concatenate([[0], np.cumsum(last - first)])
                piece = np.searchsorted(first, heads, "right") - 1
                for held, values in zip(kept, (into[:-1], rows[own], ids[own], first - ends[own],
                                               into[piece] + heads - first[piece])):
                    held.append(values)
                below = np.zeros(len(data), bool)
                for a, b in zip(first.tolist(), last.tolist()):
                    out.write(data[a:b])
                    below[a:b] = True
                size = int(into[-1])
                open_ = np.bincount(doc, minlength=len(texts)) > 0
                gone, stop = windows_below(places[again], ends)
                own = np.searchsorted(ends, gone, "right") - 1
                settled = np.split(np.stack([gone, stop], 1) - ends[own][:, None],
                                   np.searchsorted(own, np.arange(1, len(texts))))
                yield pa.record_batch([
                    batch.column(0), batch.column(1), pa.array([name] * len(texts), pa.int64()),
                    pa.array(np.diff(ends)),
                    pa.array([data[a:b][~below[a:b]].tobytes() if o else None
                              for a, b, o in zip(ends, ends[1:], open_)], pa.binary()),
                    pa.array([None if o else hashlib.sha256((t or "").encode()).hexdigest()
                              for t, o in zip(texts, open_)], pa.string()),
                    binary_rows([x.astype(np.int64) for x in settled])],
                    ["row", "doc_id", "file", "n_bytes", "rest", "plain", "settled"])
            out.write(bytes(PAD))
        bits = np.zeros(size, np.uint8)
        for places in kept[4]:
            bits[places] = 1
        for label, values in zip(("start", "row", "id", "from"), kept):
            save_array(f"{folder}/{label}-{name}",
                       np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int64))
        save_array(f"{folder}/heads-{name}", np.packbits(bits))
        os.replace(draft, f"{folder}/text-{name}")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = ("row long, doc_id long, file long, n_bytes long, rest binary, plain string, "
              "settled binary")
    path = scratch_path(docs.sparkSession, "candidates")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Flat:
    """The flat files of a folder, mapped when they are first read."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: dict[tuple[str, int], np.ndarray] = {}

    def array(self, label: str, file: int, kind) -> np.ndarray:
        if (label, file) not in self.held:
            if len(self.held) >= 1_000:
                self.held.clear()
            self.held[label, file] = map_array(f"{self.folder}/{label}-{file}", kind)
        return self.held[label, file]

    def size(self, file: int) -> int:
        return len(self.array("text", file, np.uint8)) - PAD

    def read(self, files: np.ndarray, take: Callable, shape: tuple = (0,)) -> np.ndarray:
        """``take(file, slice)`` for each stretch of one file, joined; files stand in order."""
        parts = [take(int(files[s.start]), s) for s in stretches_of(files)]
        return np.concatenate(parts) if parts else np.zeros(shape, np.uint64)

    def words(self, files: np.ndarray, places: np.ndarray, count: int,
              shift: int = 0) -> np.ndarray:
        """``count`` words from each place on, one row for each."""
        def take(file: int, some: slice) -> np.ndarray:
            text = self.array("text", file, np.uint8)
            rows = np.ndarray((len(text) - 8 * count + 1, count), ">u8", text, strides=(1, 8))
            return rows[places[some] + shift].astype(np.uint64)
        return self.read(files, take, (0, count))

    def ranks(self, files: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranks of the sampled places that follow each place, one row for each."""
        at = places + SHIFTS[places % PERIOD, 0]
        index = at // PERIOD * len(COVER) + PLACE[at % PERIOD]

        def take(file: int, some: slice) -> np.ndarray:
            held = self.array("rank", file, np.uint64)
            rows = np.ndarray((len(held) - len(COVER) + 1, len(COVER)), np.uint64, held,
                              strides=(8, 8))
            return rows[index[some]]
        return self.read(files, take, (0, len(COVER)))


def stretches_of(*columns: np.ndarray) -> list[slice]:
    """Slices in which all columns keep their values."""
    if not len(columns[0]):
        return []
    changes = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(columns[0])]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def pack(places: np.ndarray) -> bytes:
    """Rising places of one chunk: how many of each 65,536, then the low two bytes of each."""
    counts = np.bincount(places >> 16, minlength=CHUNK >> 16).astype(np.uint32)
    return counts.tobytes() + places.astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    blocks = CHUNK >> 16
    counts = np.frombuffer(packed, np.uint32, blocks)
    return (np.repeat(np.arange(blocks, dtype=np.int64) << 16, counts)
            + np.frombuffer(packed, np.uint16, offset=4 * blocks))


# --- buckets -----------------------------------------------------------------------

def bucket_bounds(spark: SparkSession, folder: str, files: DataFrame, total: int) -> np.ndarray:
    """Lower bounds of all buckets but the first, as rows of BOUND_WORDS words.

    The driver holds PER_BUCKET places of each bucket, about one in BUCKET / PER_BUCKET.
    """
    step = max(1, min(BUCKET, total) // PER_BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = Flat(folder)
        for batch in batches:
            for f in batch.column(0).to_pylist():
                places = np.arange(f % step, flat.size(f), step)
                words = flat.words(np.full(len(places), f), places, BOUND_WORDS)
                yield pa.record_batch([binary_rows([words])], ["words"])

    seen = np.concatenate([np.zeros((0, BOUND_WORDS), np.uint64), *(
        np.frombuffer(r.words, np.uint64).reshape(-1, BOUND_WORDS)
        for r in files.mapInArrow(run, "words binary").collect())])
    seen = seen[np.lexsort(seen.T[::-1])]
    return np.unique(seen[PER_BUCKET::PER_BUCKET], axis=0)


def bucket_of(bounds: np.ndarray, word: Callable[[np.ndarray | slice, int], np.ndarray],
              some: np.ndarray | slice = slice(None), level: int = 0) -> np.ndarray:
    """How many bounds each suffix reaches; ``word`` gives a word of some of the suffixes."""
    keys = word(some, level)
    low = np.searchsorted(bounds[:, level], keys, "left")
    high = np.searchsorted(bounds[:, level], keys, "right")
    if level + 1 < BOUND_WORDS:
        unsure = np.flatnonzero(low < high)
        for a in np.unique(low[unsure]):
            own = unsure[low[unsure] == a]
            b = high[own[0]]
            high[own] = a + bucket_of(bounds[a:b], word, own if level == 0 else some[own],
                                      level + 1)
    return high


def dealt(files: DataFrame, folder: str, bounds: np.ndarray, heads: bool) -> DataFrame:
    """Places of all files by bucket: the sampled ones, or those whose suffixes are sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = Flat(folder)
        for batch in batches:
            for f in batch.column(0).to_pylist():
                size = flat.size(f)
                for at in range(0, size, CHUNK):
                    end = min(at + CHUNK, size)
                    if heads:
                        bits = np.unpackbits(flat.array("heads", f, np.uint8)[at // 8:-(-end // 8)])
                        places = np.flatnonzero(bits[:end - at])
                    else:
                        places = np.flatnonzero(PLACE[np.arange(at, end) % PERIOD] >= 0)
                    if not len(places):
                        continue
                    words = words_at(flat.array("text", f, np.uint8))
                    bucket = bucket_of(bounds, lambda m, i: words[at + places[m] + 8 * i]
                                       .astype(np.uint64))
                    order = np.argsort(bucket, kind="stable")
                    cut = stretches_of(bucket[order])
                    for a in range(0, len(cut), 1_000):
                        own = cut[a:a + 1_000]
                        yield pa.record_batch([
                            pa.array([int(bucket[order[c.start]]) for c in own], pa.int64()),
                            pa.array([f] * len(own), pa.int64()),
                            pa.array([at] * len(own), pa.int64()),
                            pa.array([pack(places[order[c]]) for c in own], pa.binary())],
                            ["bucket", "file", "base", "places"])

    return files.mapInArrow(run, "bucket long, file long, base long, places binary")


def members(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Files and places of one bucket, in order."""
    rows = rows.sort_by([("file", "ascending"), ("base", "ascending")])
    parts = [unpack(p) for p in rows["places"].to_pylist()]
    sizes = [len(p) for p in parts]
    return (np.repeat(rows["file"].to_numpy(), sizes),
            np.concatenate(parts) + np.repeat(rows["base"].to_numpy(), sizes))


class Ties:
    """Members of a bucket in order, as far as it is known: groups of ties stand together.

    ``order`` holds the members that share a group with another one, ``opens`` where a group
    starts among them; ``rank`` counts the members before a member's group.
    """

    def __init__(self, size: int):
        self.rank = np.zeros(size, np.int64)
        self.order = np.arange(size)
        self.opens = np.arange(size) == 0

    def split(self, keys: np.ndarray) -> None:
        """Part the groups by a key of each of ``order``; groups of one key are not sorted."""
        group = np.cumsum(self.opens) - 1
        differs = np.concatenate([[False], ~self.opens[1:] & (keys[1:] != keys[:-1])])
        if not differs.any():
            return
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        own = np.flatnonzero(mixed[group])
        by = np.lexsort((keys[own], group[own])) if len(mixed) > 1 else np.argsort(
            keys, kind="stable")
        self.order[own] = self.order[own][by]
        keys, group = keys[own][by], group[own]
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        opens = fresh.copy()
        opens[1:] |= keys[1:] != keys[:-1]
        number = np.arange(len(own))
        self.rank[self.order[own]] += (np.maximum.accumulate(np.where(opens, number, 0))
                                       - np.maximum.accumulate(np.where(fresh, number, 0)))
        self.opens[own] = opens

    def drop(self, done: np.ndarray | None = None) -> None:
        """Let go of members that are alone in their group, and of whole groups that are done."""
        left = ~(self.opens & np.concatenate([self.opens[1:], [True]]))
        if done is not None:
            left &= ~done
        self.order, self.opens = self.order[left], self.opens[left]


def sort_by_words(flat: Flat, files: np.ndarray, places: np.ndarray, words: int) -> Ties:
    """Ranks by the first words, equal for ties."""
    ties = Ties(len(places))
    held = flat.words(files, places, words)
    for i in range(words):
        if len(ties.order):
            ties.split(held[ties.order, i])
            ties.drop()
    return ties


def resolve(ties: Ties, phase: np.ndarray, ranks: np.ndarray) -> None:
    """Order ties by cover-sample ranks: each group is parted by one of its members, repeatedly.

    ``phase`` and ``ranks`` are members' remainders, and the ranks of their next sampled places.
    """
    while len(ties.order):
        starts = np.flatnonzero(ties.opens)
        sizes = np.diff(np.concatenate([starts, [len(ties.order)]]))
        own, pivot = ties.order, np.repeat(ties.order[starts + sizes // 2], sizes)
        mine = ranks[own, MEETING[phase[own], phase[pivot]]]
        its = ranks[pivot, MEETING[phase[pivot], phase[own]]]
        side = (mine > its).astype(np.int8) - (mine < its)
        equal = np.zeros(len(ties.rank), bool)
        equal[own[side == 0]] = True
        ties.split(side)
        ties.drop(equal[ties.order])


def sample_ranks(files: DataFrame, folder: str, bounds: np.ndarray) -> None:
    """Write the ranks of all sampled suffixes beside their texts."""
    def rank(rows: pa.Table) -> pa.Table:
        where, places = members(rows)
        found = sort_by_words(Flat(folder), where, places, RANK_WORDS).rank
        cut = stretches_of(where, places // CHUNK)
        return pa.table({"file": pa.array([int(where[c.start]) for c in cut], pa.int64()),
                         "bucket": pa.array([rows["bucket"][0].as_py()] * len(cut), pa.int64()),
                         "base": pa.array([int(places[c.start]) // CHUNK * CHUNK for c in cut],
                                          pa.int64()),
                         "places": pa.array([pack(places[c] % CHUNK) for c in cut], pa.binary()),
                         "ranks": binary_rows([found[c].astype(np.uint32) for c in cut])})

    def place(rows: pa.Table) -> pa.Table:
        file = rows["file"][0].as_py()
        size = Flat(folder).size(file)
        values = np.zeros((size // PERIOD + 3) * len(COVER), np.int64)
        for bucket, base, packed, found in zip(*(
                rows[c].to_pylist() for c in ("bucket", "base", "places", "ranks"))):
            at = unpack(packed) + base
            values[at // PERIOD * len(COVER) + PLACE[at % PERIOD]] = (
                (bucket << 32) + np.frombuffer(found, np.uint32).astype(np.int64))
        save_array(f"{folder}/rank-{file}", values)
        return pa.table({"n": pa.array([len(values)], pa.int64())})

    (dealt(files, folder, bounds, False).groupBy("bucket")
     .applyInArrow(rank, "file long, bucket long, base long, places binary, ranks binary")
     .groupBy("file").applyInArrow(place, "n long").agg(F.sum("n")).collect())


def later_windows(flat: Flat, files: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which suffixes of a bucket share SPAN bytes with an earlier one."""
    ties = sort_by_words(flat, files, places, DEEP)
    near, tied = ties.rank.copy(), np.sort(ties.order)
    gone = np.zeros(len(places), bool)
    if not len(tied):
        return gone
    ranks = np.zeros((len(places), len(COVER)), np.uint64)
    ranks[tied] = flat.ranks(files[tied], places[tied])
    resolve(ties, places % PERIOD, ranks)
    rank = ties.rank
    order = tied[np.argsort(rank[tied], kind="stable")]
    # Neighbours of one rank are equal beyond SPAN; others may differ only after it.
    same = rank[order][1:] == rank[order][:-1]
    unsure = np.flatnonzero(~same & (near[order][1:] == near[order][:-1]))
    both = np.unique(np.concatenate([order[unsure], order[unsure + 1]]))
    spot = np.zeros(len(places), np.int64)
    spot[both] = np.arange(len(both))
    a, b = spot[order[unsure]], spot[order[unsure + 1]]
    alike = np.ones(len(unsure), bool)
    for shift in [*range(8 * DEEP, SPAN - 8, 8), SPAN - 8]:
        words = flat.words(files[both], places[both], 1, shift)[:, 0]
        alike &= words[a] == words[b]
    same[unsure[alike]] = True
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    ids = np.zeros(len(places), np.int64)
    ids[tied] = flat.read(files[tied], lambda f, s: flat.array("id", f, np.int64)[
        np.searchsorted(flat.array("start", f, np.int64), places[tied][s], "right") - 1])
    # Members are numbered by file and place, that is by row and place: of those with a group's
    # smallest doc_id the first member stays.
    least = np.repeat(np.minimum.reduceat(ids[order], starts), sizes)
    first = np.minimum.reduceat(np.where(ids[order] == least, order, len(places)), starts)
    gone[order] = True
    gone[first] = False
    return gone


def mark_repeats(files: DataFrame, folder: str, bounds: np.ndarray) -> None:
    """Write bits of the windows that repeat an earlier one, beside their texts."""
    def sort(rows: pa.Table) -> pa.Table:
        where, places = members(rows)
        found = later_windows(Flat(folder), where, places)
        where, places = where[found], places[found]
        cut = stretches_of(where, places // CHUNK)
        return pa.table({"file": pa.array([int(where[c.start]) for c in cut], pa.int64()),
                         "base": pa.array([int(places[c.start]) // CHUNK * CHUNK for c in cut],
                                          pa.int64()),
                         "places": pa.array([pack(places[c] % CHUNK) for c in cut], pa.binary())})

    def place(rows: pa.Table) -> pa.Table:
        file = rows["file"][0].as_py()
        bits = np.zeros(Flat(folder).size(file), np.uint8)
        for base, packed in zip(rows["base"].to_pylist(), rows["places"].to_pylist()):
            bits[unpack(packed) + base] = 1
        save_array(f"{folder}/gone-{file}", np.packbits(bits))
        return pa.table({"n": pa.array([int(bits.sum())], pa.int64())})

    (dealt(files, folder, bounds, True).groupBy("bucket")
     .applyInArrow(sort, "file long, base long, places binary")
     .groupBy("file").applyInArrow(place, "n long").agg(F.sum("n")).collect())


# --- result ------------------------------------------------------------------------

RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "kept binary, spans binary")


def cut_documents(candidates: DataFrame, folder: str) -> DataFrame:
    """Documents with open verdicts without their repeated bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = Flat(folder)
        for batch in slices(batches, 4, TEXTS):
            out = []
            for row, doc_id, file, size, rest, settled in zip(
                    *(batch.column(i).to_pylist() for i in range(6))):
                held = [np.frombuffer(settled, np.int64).reshape(-1, 2)]
                rows = flat.array("row", file, np.int64)
                bits = flat.array("gone", file, np.uint8)
                text = flat.array("text", file, np.uint8)
                at = flat.array("start", file, np.int64)
                data, below = np.empty(size, np.uint8), np.zeros(size, bool)
                a, b = np.searchsorted(rows, [row, row + 1])
                for piece in range(a, b):
                    first = int(at[piece])
                    last = int(at[piece + 1]) if piece + 1 < len(at) else flat.size(file)
                    shift = int(flat.array("from", file, np.int64)[piece])
                    data[shift:shift + last - first] = text[first:last]
                    below[shift:shift + last - first] = True
                    if len(bits):
                        own = np.unpackbits(bits[first // 8:-(-last // 8)])
                        begin, stop = stretches(own[first % 8:][:last - first])
                        held.append(np.stack([begin, stop + SPAN - 1], 1) + shift)
                data[~below] = np.frombuffer(rest, np.uint8)
                both = np.concatenate(held)
                gone = covered(len(data), both[:, 0], both[:, 1])
                kept = data[~gone].tobytes()
                spans = np.stack(stretches(gone), 1).astype(np.int64)
                out.append((doc_id, len(data), int(gone.sum()), len(spans),
                            hashlib.sha256(kept).hexdigest(), kept, spans.tobytes()))
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return candidates.select("row", "doc_id", "file", "n_bytes", "rest", "settled").mapInArrow(
        run, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document without the bytes below strings of SPAN bytes that also start earlier.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, and where bytes were removed kept (the
    remaining bytes) and spans (pairs of 64-bit start and end).

    Defined results: a null text counts as empty; a null doc_id comes before all others; rows with
    the same doc_id count in the table's order; an empty table gives no rows; other columns are
    ignored. Remaining bytes need not be whole UTF-8 characters, so they are binary.
    """
    spark = docs.sparkSession
    folder = shared_folder_for(spark, "suffixes")
    parts = max(1, -(-input_bytes(docs) // PART_BYTES))
    repeated_hashes(docs, folder, parts)
    candidates = candidate_text(docs, folder, parts)
    found = candidates.filter(F.col("plain").isNull())
    files = materialize(found.select("file").distinct(), "files")
    files = files.repartition(max(1, files.count()))  # one row a task, each a whole flat text
    total = found.agg(F.sum("n_bytes")).first()[0] or 0
    if total:
        bounds = bucket_bounds(spark, folder, files, total)
        sample_ranks(files, folder, bounds)
        mark_repeats(files, folder, bounds)
    whole = candidates.filter(F.col("plain").isNotNull()).select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("plain").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"), F.lit(None).cast("binary").alias("spans"))
    return whole.unionByName(cut_documents(found, folder))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")
