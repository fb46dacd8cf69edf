"""Size-aware heavy-light join of documents by the Jaccard similarity of word n-grams.

Two documents link if 100 * |A & B| >= percent * |A | B| for their sets A, B of distinct 5-word
shingles (64-bit hashes). The join is exact; its steps:

1. *Scan.* Each text's set, its size and a 128-bit signature. Equal sets form a class; only one
   row per class goes on. The same pass counts in how many texts each shingle lies (by the upper
   32 bits of its hash, which may only overcount). Counts of two and more are written as sorted
   arrays that later tasks map into memory.
2. *Filter.* A set can link to a different one only if at least ``percent`` of its shingles lie in
   other texts too. Sets that pass are written as flat arrays; the others are done.
3. *Light sets* (at most ``boundary`` shingles) enumerate fixed-size subsets: sets whose larger
   one has t shingles link only if they share ceil(percent * t) of them, so equal subsets of that
   size are candidates. *Heavy sets* scan inverted lists: of the shingles in order of their
   counts, rarest first, only the first |A| - ceil(percent * |A|) + 1 have to be looked up. The
   boundary is chosen by cost: the largest size up to which enumerating makes no more keys than
   the lists would make entries to scan.
4. *Lists to links.* Only the classes are asked for, so pairs inside a class already found need no
   test. In the first rounds each list tests its members against one of them, the one whose
   shingles are most common (the likely original of a group of copies). What is left, pairs of
   one list in different components, is tested completely.

Lists of hot shingles are dealt over several tasks by a salt that follows the count, and every
list is cut into chunks; the last round meets the chunks of a list with each other, except two
of light sets only.

Defined results: null text, or text without words, has size 0 and is linked with nothing; fewer
than five words are one shingle; repeated rows stay, each with its component; a null doc_id has
a null component and links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import (
    input_bytes, map_array, save_array, shared_folder_for, slices, table,
)
from murmura.llm.components import components
from murmura.llm.word_keys import TEXTS, mixed, word_keys
from murmura.runtime import materialize

WORDS = 5
PERCENT = 75
BUCKET_BYTES = 24 << 20
"""Bytes of text per bucket of shingle counts and of inverted lists."""
LOOKED_UP = 4 << 20
"""Bytes of text whose shingles are looked up together."""
FLUSH = 1_000_000
"""Shingles or list entries that a task holds before it hands them on."""
CHUNK = 1_024
"""Members of a chunk of an inverted list."""
SALT_EVERY = 20_000
"""A list of so many entries is dealt to one more task."""
LIGHT_MOST = 12
"""Sizes up to which the boundary may rise; above it subsets are too many at any data."""
PIVOT_ROUNDS = 3
OFFSET_BITS = 40
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    keys, counts = word_keys(texts)
    ends = np.cumsum(counts) - 1  # the last key of a text is its end
    return [shingle_set(keys[end - n + 1:end], size) for n, end in zip(counts.tolist(), ends.tolist())]


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(size, len(hashes))
    sums = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        sums = sums * MULTIPLIER + hashes[i:len(hashes) - width + 1 + i]
    return np.unique(mixed(sums))


def at_least(n, percent: int):
    """ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    common = int((b[place] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


SCAN = "doc_id long, n_shingles long, sig binary, bucket int, data binary"


def scanner(bits: int, size: int):
    """Arrow batches of (doc_id, text) to a row per document and blocks of shingle keys.

    A key is the bucket's ``bits`` and the 32 bits after them, so keys grow with the buckets.
    """
    def blocks(keys: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(keys))
        cut = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(32))
        parts = [(i, p.astype(np.uint32)) for i, p in enumerate(np.split(values, cut)) if len(p)]
        none = [None] * len(parts)
        return pa.record_batch(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()),
             pa.array([i for i, _ in parts], pa.int32()),
             pa.array([packed(p) for _, p in parts], pa.binary())],
            ["doc_id", "n_shingles", "sig", "bucket", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in slices(batches, 1, TEXTS):
            sizes, signatures = [], []
            for found in shingle_sets(batch.column(1), size):
                sizes.append(len(found))
                signatures.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(found >> np.uint64(32 - bits))
                held += len(found)
                if held >= FLUSH:
                    yield blocks(keys)
                    keys, held = [], 0
            none = [None] * len(sizes)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                ["doc_id", "n_shingles", "sig", "bucket", "data"])
        if held:
            yield blocks(keys)
    return scan


def count_writer(folder: str):
    """Blocks of one bucket to sorted arrays of the keys that occur twice or more, and counts."""
    def write(blocks: pa.Table) -> pa.Table:
        bucket = blocks.column("bucket")[0].as_py()
        values = np.sort(np.concatenate([unpacked(b) for b in blocks.column("data").to_pylist()]))
        starts = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint32(1)))
        counts = np.diff(starts, append=len(values))
        often = counts > 1
        save_array(f"{folder}/keys-{bucket}", values[starts[often]])
        save_array(f"{folder}/counts-{bucket}", counts[often].astype(np.uint32))
        return pa.table({"bucket": pa.array([bucket], pa.int32()),
                         "keys": pa.array([int(often.sum())], pa.int64())})
    return write


class Counts:
    """In how many texts a shingle lies: 1, or the count in the mapped arrays."""

    def __init__(self, folder: str, bits: int):
        self.bits = bits
        self.parts = [(map_array(f"{folder}/keys-{i}", np.uint32),
                       map_array(f"{folder}/counts-{i}", np.uint32)) for i in range(1 << bits)]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """For sorted shingles, whose buckets therefore follow each other."""
        keys = shingles >> np.uint64(32 - self.bits)
        cuts = np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=np.uint64)
                               << np.uint64(32))
        keys = keys.astype(np.uint32)
        out = np.ones(len(keys), np.int64)
        for i in np.flatnonzero(np.diff(cuts)):
            own, counts = self.parts[i]
            if len(own):
                mine = keys[cuts[i]:cuts[i + 1]]
                at = np.searchsorted(own, mine)
                at[at == len(own)] = 0
                hit = own[at] == mine
                out[cuts[i]:cuts[i + 1]][hit] = counts[at[hit]]
        return out


    def of_all(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """For the sets of many texts; every bucket is looked into once."""
        if not sets:
            return []
        every = np.concatenate(sets)
        order = np.argsort(every)
        out = np.empty(len(every), np.int64)
        out[order] = self.of(every[order])
        return np.split(out, np.cumsum([len(s) for s in sets])[:-1])


@lru_cache(maxsize=2)
def counts_of(folder: str, bits: int) -> Counts:
    return Counts(folder, bits)


def rep_writer(folder: str):
    def write(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        save_array(f"{folder}/reps-{bucket}", np.sort(rows.column("rep").to_numpy()))
        return rows.slice(0, 1).select(["bucket"])
    return write


@lru_cache(maxsize=2)
def reps_of(folder: str, buckets: int) -> list[np.ndarray]:
    return [map_array(f"{folder}/reps-{i}", np.int64) for i in range(buckets)]


def in_sorted(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return values[at] == wanted


ENTRIES = ("node long, n int, sig binary, scan_cost long, score long, "
           "bucket int, hashes binary, nodes binary, sizes binary, scores binary, dfs binary, places binary")


def set_writer(folder: str, bits: int, rep_buckets: int, size: int, percent: int):
    """Sets that may link, to this task's flat file; a row each, and blocks of list entries.

    A node is the place of a set: file number and offset. The set's length stands before it.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, reps = counts_of(folder, bits), reps_of(folder, rep_buckets)
        task, offset = TaskContext.get().partitionId(), 0
        sets, rows, entries, held = [], [], [], 0

        def blocks() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*entries)]
            hashes, nodes, dfs = columns[0], columns[1], columns[4]
            salts = mixed(nodes.astype(np.uint64)) % (1 + dfs.astype(np.uint64) // np.uint64(SALT_EVERY))
            bucket = ((hashes >> np.uint64(64 - bits)) + salts) % np.uint64(1 << bits)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(1, 1 << bits))
            parts = [(i, p) for i, p in enumerate(np.split(order, cuts)) if len(p)]
            return batch_of([], [(i, *(v[p].tobytes() for v in columns))
                                 for i, p in parts])

        for batch in slices(batches, 1, LOOKED_UP):
            wanted = [doc_id is not None and bool(in_sorted(reps[doc_id % rep_buckets], np.array([doc_id]))[0])
                      for doc_id in batch.column(0).to_pylist()]
            texts = batch.filter(pa.array(wanted, pa.bool_()))
            founds = [f for part in slices([texts], 1, TEXTS) for f in shingle_sets(part.column(1), size)
                      if len(f)]
            for found, df in zip(founds, counts.of_all(founds)):
                n = len(found)
                need = at_least(n, percent)
                if int((df > 1).sum()) < need:
                    continue
                node = task << OFFSET_BITS | offset
                sets += [np.array([n], np.uint64), found]
                offset += n + 1
                prefix = np.lexsort((found, df))[:n - need + 1]
                places = np.flatnonzero(df[prefix] > 1).astype(np.int32)
                prefix = prefix[places]
                score = int(1_000 * df.sum() // n)
                rows.append((node, n, xxhash.xxh3_128_digest(found.tobytes()),
                             int(df[prefix].sum()), score))
                if len(prefix):
                    k = len(prefix)
                    entries.append((found[prefix], np.full(k, node), np.full(k, n, np.int32),
                                    np.full(k, score), df[prefix], places))
                    held += k
                if held >= FLUSH:
                    yield blocks()
                    entries, held = [], 0
            yield batch_of(rows, [])
            rows = []
        if held:
            yield blocks()
        if sets:
            save_array(f"{folder}/sets-{task}", np.concatenate(sets))
    return write


def batch_of(rows: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(),
             pa.int32(), *[pa.binary()] * 6]
    names = [part.split()[0] for part in ENTRIES.split(", ")]
    full = [(*r, *[None] * 7) for r in rows] + [(*[None] * 5, *b) for b in blocks]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*full), kinds)]
                           if full else [pa.array([], k) for k in kinds], names)


class Sets:
    """Sets by node, from memory-mapped files."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __getitem__(self, node: int) -> np.ndarray:
        task, offset = node >> OFFSET_BITS, node & ((1 << OFFSET_BITS) - 1)
        if task not in self.files:
            self.files[task] = map_array(f"{self.folder}/sets-{task}", np.uint64)
        data = self.files[task]
        return data[offset + 1:offset + 1 + int(data[offset])]


def list_maker(heavy_from: int):
    """Blocks of one bucket to chunks of inverted lists with two members or more.

    Members are ordered by size. A list of light sets only is left out: their subsets find them.
    The light part of a dealt list stays, as the list's heavy sets may lie in other buckets.
    """
    def make(blocks: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(b, kind) for b in blocks.column(name).to_pylist()])

        hashes, nodes = column("hashes", np.uint64), column("nodes", np.int64)
        sizes, scores = column("sizes", np.int32), column("scores", np.int64)
        dfs, places = column("dfs", np.int64), column("places", np.int32)
        order = np.lexsort((nodes, sizes, hashes))
        hashes, nodes, sizes, scores, dfs, places = (
            x[order] for x in (hashes, nodes, sizes, scores, dfs, places))
        starts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
        lengths = np.diff(starts, append=len(hashes))
        names = ["list_id", "part", "salted", "heavy", "first", "nodes", "sizes", "scores", "places"]
        out, seen = {k: [] for k in names}, set()
        # Of lists with the same members the one whose shingle comes first in order is kept.
        sums = np.add.reduceat(places.astype(np.int64), starts)
        by_place = np.argsort(sums, kind="stable")
        starts, lengths, sums = starts[by_place], lengths[by_place], sums[by_place]
        for first, start, length in zip(sums.tolist(), starts.tolist(), lengths.tolist()):
            end, salted = start + length, bool(dfs[start] >= SALT_EVERY)
            if not salted and (length < 2 or sizes[end - 1] < heavy_from):
                continue
            members = nodes[start:end].tobytes()
            if not salted:
                mark = xxhash.xxh3_128_intdigest(members)
                if mark in seen:
                    continue
                seen.add(mark)
            for part, at in enumerate(range(start, end, CHUNK)):
                stop = min(at + CHUNK, end)
                out["list_id"].append(int(hashes[start] >> np.uint64(1)))
                out["part"].append(part)
                out["salted"].append(salted or length > CHUNK)
                out["heavy"].append(bool(sizes[stop - 1] >= heavy_from))
                out["first"].append(first)
                for name, values in (("nodes", nodes), ("sizes", sizes), ("scores", scores),
                                     ("places", places)):
                    out[name].append(values[at:stop].tobytes())
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(out[n], k) for n, k in zip(names, kinds)], names)
    return make


LISTS = ("list_id long, part int, salted boolean, heavy boolean, first long, nodes binary, sizes binary, "
         "scores binary, places binary")


def pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each unordered pair of different nodes once."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0).reshape(-1, 2)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


class Roots:
    """Component of a node, from mapped arrays; a node that is in none is its own."""

    def __init__(self, folder: str, buckets: int):
        self.buckets = buckets
        self.parts = [(map_array(f"{folder}/node-{i}", np.int64), map_array(f"{folder}/root-{i}", np.int64))
                      for i in range(buckets)]

    def of(self, nodes: np.ndarray) -> np.ndarray:
        out, bucket = nodes.copy(), nodes % self.buckets
        for i in np.unique(bucket):
            own, roots = self.parts[i]
            if len(own):
                mine = np.flatnonzero(bucket == i)
                at = np.searchsorted(own, nodes[mine])
                at[at == len(own)] = 0
                hit = own[at] == nodes[mine]
                out[mine[hit]] = roots[at[hit]]
        return out


def root_writer(folder: str):
    def write(rows: pa.Table) -> pa.Table:
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        order, bucket = np.argsort(node), rows.column("bucket")[0].as_py()
        save_array(f"{folder}/node-{bucket}", node[order])
        save_array(f"{folder}/root-{bucket}", root[order])
        return rows.slice(0, 1).select(["bucket"])
    return write


@lru_cache(maxsize=1)
def roots_of(folder: str, buckets: int) -> Roots:
    return Roots(folder, buckets)


def save_roots(found: DataFrame, folder: str, buckets: int) -> None:
    bucketed = found.select("node", "root", F.expr(f"int(pmod(node, {buckets}))").alias("bucket"))
    bucketed.groupBy("bucket").applyInArrow(root_writer(folder), "bucket int").count()


def fits(sizes_a, places_a, sizes_b, places_b, percent: int):
    """Whether sizes and places leave room for a link.

    Taken in the list of the pair's first common shingle, nothing before the two places is
    common, so at most the shorter rest is. The pair's other lists may pass it by.
    """
    needed = -(-percent * (sizes_a + sizes_b) // (100 + percent))
    return np.minimum(sizes_a - places_a, sizes_b - places_b) >= needed


def pivot_pairs(folder: str | None, buckets: int, percent: int):
    """Each member against the best-scored one; later rounds: the best outside the largest
    component of the list, against the members of other components."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for nodes, sizes, scores, spots in zip(*(
                    batch.column(c).to_pylist() for c in ("nodes", "sizes", "scores", "places"))):
                nodes, sizes = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int32)
                scores, spots = np.frombuffer(scores, np.int64), np.frombuffer(spots, np.int32)
                rest = np.ones(len(nodes), bool)
                if folder:
                    roots = roots_of(folder, buckets).of(nodes)
                    values, counts = np.unique(roots, return_counts=True)
                    if len(values) < 2:
                        continue
                    rest = roots != values[counts.argmax()]
                places = np.flatnonzero(rest)
                pivot = places[scores[places].argmax()]
                other = fits(sizes, spots, sizes[pivot], spots[pivot], percent)
                if folder:
                    other &= roots != roots[pivot]
                left.append(nodes[other])
                right.append(np.full(int(other.sum()), nodes[pivot]))
            if left:
                yield pair_batch(np.concatenate(left), np.concatenate(right))
    return pairs


def all_pairs(folder: str, buckets: int, percent: int, sets_folder: str):
    """The links among all pairs of two chunks (or of one) that lie in different components."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, test = roots_of(folder, buckets), verifier(sets_folder, percent)
        names = [c + end for end in ("", "_b") for c in ("nodes", "sizes", "places")]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                a, na, pa_, b, nb, pb = (np.frombuffer(x, np.int64 if i % 3 == 0 else np.int32)
                                         for i, x in enumerate(row))
                ra, rb = roots.of(a), roots.of(b)
                if len(np.unique(np.concatenate([ra, rb]))) < 2:
                    continue
                i, j = np.nonzero((ra[:, None] != rb[None, :]) & fits(
                    na[:, None], pa_[:, None], nb[None, :], pb[None, :], percent))
                if len(i):
                    yield from test([pair_batch(a[i], b[j])])
    return pairs


def verifier(folder: str, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in batches:
            keep = [similar(sets[u], sets[v], percent) for u, v in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return verify


def enumerator(folder: str, bits: int, percent: int):
    """Blocks of subset keys of light sets: for each size t of a pair's larger set, all subsets
    of ceil(percent * t) shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in batches:
            found = []
            for node, score in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sets[node].tolist()
                for t in range(len(own), 100 * len(own) // percent + 1):
                    for subset in combinations(own, at_least(t, percent)):
                        key = xxhash.xxh3_64_intdigest(np.array([t, *subset], np.uint64).tobytes())
                        found.append((key, node, len(own), score))
            if not found:
                continue
            keys, nodes, sizes, scores = zip(*found)
            columns = (np.array(keys, np.uint64), np.array(nodes, np.int64),
                       np.array(sizes, np.int32), np.array(scores, np.int64),
                       np.ones(len(keys), np.int64), np.zeros(len(keys), np.int32))
            bucket = columns[0] >> np.uint64(64 - bits)
            yield batch_of([], [(int(i), *(c[bucket == i].tobytes() for c in columns))
                                for i in np.unique(bucket)])
    return run


def keys_of(size: int, percent: int) -> int:
    """How many subset keys a set of this size makes."""
    return sum(comb(size, at_least(t, percent)) for t in range(size, 100 * size // percent + 1))


def choose_boundary(nodes: DataFrame, percent: int) -> int:
    """The largest size up to which enumeration makes no more keys than lists make entries.

    At most LIGHT_MOST rows come to the driver.
    """
    costs = nodes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").agg(
        F.count("*").alias("sets"), F.sum("scan_cost").alias("scan")).orderBy("n").collect()
    light = 0
    for row in costs:
        if row["sets"] * keys_of(row["n"], percent) > max(row["scan"], row["sets"]):
            break
        light = row["n"]
    return light


def link_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module's text."""
    spark = docs.sparkSession
    folder = shared_folder_for(spark, "ngram-join")
    texts = docs.select("doc_id", "text")
    bits = max(3, (input_bytes(docs) // BUCKET_BYTES).bit_length())

    scanned = materialize(texts.mapInArrow(scanner(bits, size), SCAN), "shingles")
    scanned.filter("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(
        count_writer(folder), "bucket int, keys long").count()
    rows = scanned.filter("bucket is null").select("doc_id", "n_shingles", "sig")
    linkable = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    rep_buckets = 1 << bits
    classes.select("rep", F.expr(f"int(pmod(rep, {rep_buckets}))").alias("bucket")).groupBy(
        "bucket").applyInArrow(rep_writer(folder), "bucket int").count()

    kept = materialize(texts.mapInArrow(
        set_writer(folder, bits, rep_buckets, size, percent), ENTRIES), "sets")
    nodes = kept.filter("bucket is null").select("node", "n", "sig", "scan_cost", "score")
    boundary = choose_boundary(nodes, percent)
    block = ["bucket", "hashes", "nodes", "sizes", "scores", "dfs", "places"]
    heavy = kept.filter("bucket is not null").select(*block).groupBy("bucket").applyInArrow(
        list_maker(boundary + 1), LISTS)
    light = nodes.filter(F.col("n") <= boundary).select("node", "score").mapInArrow(
        enumerator(folder, bits, percent), ENTRIES).select(*block).groupBy("bucket").applyInArrow(
        list_maker(0), LISTS)
    made = materialize(heavy.unionByName(light), "lists")
    rest = ["list_id", "part", "salted", "heavy", "first", "sizes", "scores", "places"]
    single = made.filter("not salted").groupBy("nodes").agg(
        F.min_by(F.struct(*rest), "first").alias("l")).select("nodes", "l.*")
    lists = materialize(single.unionByName(made.filter("salted")), "lists")

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().mapInArrow(verifier(folder, percent), "u long, v long")

    edges = spark.createDataFrame([], "u long, v long")
    for turn in range(PIVOT_ROUNDS):
        at = f"{folder}/roots-{turn}"
        pairs = lists.filter("heavy").select("nodes", "sizes", "scores", "places").mapInArrow(
            pivot_pairs(at if turn else None, rep_buckets, percent), "u long, v long")
        edges = materialize(edges.unionByName(verified(pairs)), "links")
        roots = components(edges)
        folder_next = f"{folder}/roots-{turn + 1}"
        os.makedirs(folder_next, exist_ok=True)
        save_roots(roots, folder_next, rep_buckets)
    parts = ["nodes", "sizes", "places"]
    chunk = lists.select("list_id", "salted", "heavy", *parts)
    sides = ["heavy", *parts]
    other = chunk.filter("salted").select("list_id", *[F.col(c).alias(f"{c}_b") for c in sides])
    met = chunk.filter("salted").join(other, "list_id").filter("heavy or heavy_b").unionByName(
        chunk.filter("not salted").withColumns({f"{c}_b": F.col(c) for c in sides}))
    met = met.select(*parts, *[f"{c}_b" for c in parts])
    more = materialize(met.mapInArrow(
        all_pairs(folder_next, rep_buckets, percent, folder), "u long, v long").distinct(), "links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))

    # Node components to class components, named by their smallest doc_id.
    node_root = nodes.select("node", "sig").join(roots, "node", "left").select(
        "sig", F.coalesce("root", "node").alias("root"))
    class_root = classes.join(node_root.groupBy("sig").agg(F.min("root").alias("root")), "sig", "left")
    smallest = class_root.filter("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    named = class_root.join(smallest, "root", "left").select(
        "sig", F.coalesce("least", "rep").alias("component"))
    return rows.join(named, "sig", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
