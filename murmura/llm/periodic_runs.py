"""Runs of repeated word patterns, found octave by octave on overlapping tiles.

Period octave s covers the periods s to 2s - 1. A run of such a period and of four periods or
more has at least 3s places i where word i equals word i + period; call them its match interval.
So the interval holds a boundary, a multiple of s, with 2s matches or more after it.

Tiles. A document is exploded into one tile per octave and boundary c: the words from c - s to
c + 5s. A tile is solved alone: the Z-function of the words from c on gives the matches after c
for every period of the octave, and the Z-function of the reversed words gives those before c. The
same table tells whether a period's block is a power of a shorter one, which belongs to a lower
octave. Only tiles where the 2s words at the boundary come again one period later are solved; a
hash of word blocks, doubled from octave to octave, finds them without missing any.

Stitching. Fragments end where their tile ends. Neighbouring tiles of a task are joined in groups
of JOINED, the rest is shuffled by document and period, and touching intervals become one run.
Texts are shuffled only where a document has fragments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import slices, table
from murmura.runtime import materialize

LEAST_WORDS, LEAST_POWER = 6, 4
JOINED = 64
"""Neighbouring tiles of one octave whose fragments a task joins before the shuffle."""
BATCH = 4 << 20
"""Bytes of text that are tiled together."""

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
EMPTY = hashlib.sha256(b"").hexdigest()
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def words_of(text: str | None) -> list[bytes]:
    """Stretches without blank (space, tab to carriage return), in UTF-8."""
    return (text or "").encode().split()


def tail_pattern(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Start and period of the tail that the query makes periodic, for a tenth of the ids."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    return start, 1 + (n - start) // (3 + g % 8)


def with_tail(doc_id: int | None, words: list) -> list:
    """The words with the periodic tail, if the id has one."""
    found = tail_pattern(doc_id, len(words))
    if not found:
        return words
    start, period = found
    block = words[start:start + period]
    left = len(words) - start
    return words[:start] + (block * (left // period + 1))[:left]


def z_function(s: list, upto: int) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on, for i below ``upto``."""
    n = len(s)
    z = [n] + [0] * (min(upto, n) - 1)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_factors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] * (q > 1)


def solve_tile(words: np.ndarray, c: int, s: int,
               periods: list[int]) -> list[tuple[int, int, int]]:
    """Match intervals (period, from, to) that touch boundary c, for periods of octave s.

    Left out: periods whose block is a power of a shorter one, and intervals that end inside the
    tile on both sides and are too short for a run.
    """
    ahead = words[c:c + 5 * s].tolist()
    first = max(c - s, 0)
    # The reversed words before c, a mark that equals nothing, and those before c + 2s.
    behind = words[first:c][::-1].tolist()
    mark = len(behind) + 1
    after = words[c:c + 2 * s].tolist()
    behind += [None, *after[::-1], *words[first:c][::-1].tolist()]
    forth, back = z_function(ahead, 2 * s), z_function(behind, mark + len(after))
    found = []
    for q in periods:
        if q >= len(forth) or any(forth[q // r] >= q - q // r for r in prime_factors(q)):
            continue
        here, before = forth[q], back[mark + len(after) - q]
        cut = c + q + here == c + len(ahead) or before == c - first
        if cut or here + before >= max(LEAST_WORDS, LEAST_POWER * q) - q:
            found.append((q, c - before, c + here))
    return found


def fragments(codes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per document its match intervals (period, from, to), from tiles of every octave.

    ``codes`` are the documents' words as numbers; no number occurs in two documents.
    """
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    sizes = np.array([len(codes[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.empty(int(starts[-1]), np.int64)
    for rank, i in enumerate(order):
        words[starts[rank]:starts[rank] + sizes[rank]] = codes[i]
        words[starts[rank] + sizes[rank]] = -1 - rank  # equals no other place
    found: list[list] = [[] for _ in codes]
    name, s = words.astype(np.uint64) * M1, 1
    while True:
        held = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_POWER * s), "right"))
        end = int(starts[held])
        if not held or end < 4 * s:
            return found
        name = name[:end]
        pair = name[:-s] * M2 + name[s:]  # names of blocks of 2s words
        pair ^= pair >> np.uint64(31)
        pair *= M3
        rows = -(-len(pair) // s)
        grid = np.zeros(rows * s, np.uint64)
        grid[:len(pair)] = pair
        grid = grid.reshape(rows, s)
        at, shift = np.nonzero(grid[1:] == grid[:-1, :1])
        tiles: dict[int, list[int]] = {}
        for c, q in zip((at * s).tolist(), (s + shift).tolist()):
            tiles.setdefault(c, []).append(q)
        open_: dict[int, list] = {}  # period -> group of tiles, interval and place to put it
        for c, periods in tiles.items():
            for q, a, b in solve_tile(words[:end], c, s, periods):
                last = open_.get(q)
                if last and last[0] == c // (JOINED * s) and a <= last[1][2]:
                    last[1][1], last[1][2] = min(a, last[1][1]), max(b, last[1][2])
                    continue
                doc = int(np.searchsorted(starts, c, "right")) - 1
                interval = [q, a, b, int(starts[doc])]
                open_[q] = [c // (JOINED * s), interval]
                found[order[doc]].append(interval)
        name, s = pair, 2 * s


def numbered(doc_ids: list, texts: list) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of each document with its tail, and the same as numbers of its own."""
    all_words, codes, base = [], [], 0
    for doc_id, text in zip(doc_ids, texts):
        words = with_tail(doc_id, words_of(text))
        known: dict[bytes, int] = {}
        numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64,
                              len(words))
        codes.append(numbers + base)
        base += len(known)
        all_words.append(words)
    return all_words, codes


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of every document; text goes on only where there are some."""
    for batch in slices(batches, 2, BATCH):
        ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        words, codes = numbered(ids, texts)
        found = [[{"period": q, "a": a - base, "b": b - base} for q, a, b, base in f]
                 for f in fragments(codes)]
        yield pa.record_batch([
            batch.column(0), batch.column(1),
            pa.array([t if f else None for t, f in zip(texts, found)], pa.string()),
            pa.array([None if f else hashlib.sha256(b" ".join(w)).hexdigest()
                      for w, f in zip(words, found)], pa.string()),
            pa.array(found, pa.list_(pa.struct([("period", pa.int64()), ("a", pa.int64()),
                                                ("b", pa.int64())])))],
            ["row", "doc_id", "text", "plain", "fragments"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result row per document from its text and its stitched runs."""
    for batch in slices(batches, 1, BATCH):
        out = []
        for doc_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            out.append(summary(doc_id, with_tail(doc_id, words_of(text)),
                               [(r["start"], r["length"], r["period"]) for r in runs or []]))
        yield pa.RecordBatch.from_pylist(out, schema=RESULT_ARROW)


RESULT_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string())
                          for x in RESULT.split(", ")])


def summary(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """The digest columns of one document; ``runs`` are (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return {"doc_id": doc_id, "n_runs": len(runs), "start": top[0], "length": top[1],
            "period": top[2], "exponent_milli": runs and 1000 * top[1] // top[2] or None,
            "runs_sha256": hashlib.sha256(
                "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


def tiled_documents(docs: DataFrame) -> DataFrame:
    """A written table of documents with their fragments: row, doc_id, text, plain, fragments."""
    numbered_rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(numbered_rows.mapInArrow(
        _tiled, "row long, doc_id long, text string, plain string, "
                "fragments array<struct<period: long, a: long, b: long>>"), "tiles")


def stitch(tiled: DataFrame) -> DataFrame:
    """Runs ``row, start, length, period``: touching intervals of a document and period joined."""
    along = Window.partitionBy("row", "period").orderBy("a", "b")
    reach = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))
    return (tiled.select("row", F.inline("fragments"))
            .withColumn("opens", opens)
            .withColumn("part", F.sum("opens").over(along))
            .groupBy("row", "period", "part").agg(F.min("a").alias("start"), F.max("b").alias("b"))
            .select("row", "start", (F.col("b") - F.col("start") + F.col("period"))
                    .alias("length"), "period")
            .filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS),
                                                  LEAST_POWER * F.col("period"))))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Every document's runs of a repeated word pattern, in digests; one row per input row.

    Defined results: a null or empty text has no words and no run; a null doc_id stays null and
    gets no made-up tail; rows that repeat are judged one by one; an empty table gives no rows;
    other columns, also of clashing names, are ignored. A text of any length is one document: its
    word numbers and two tables of hashes are held at a time, its tiles one after the other.
    """
    tiled = tiled_documents(docs)
    runs = stitch(tiled).groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    without = tiled.filter(F.col("plain").isNotNull()).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"),
        *[F.lit(None).cast("long").alias(c)
          for c in ("start", "length", "period", "exponent_milli")],
        F.lit(EMPTY).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    within = (tiled.filter(F.col("plain").isNull()).select("row", "doc_id", "text")
              .join(runs, "row", "left").select("doc_id", "text", "runs")
              .mapInArrow(_collapsed, RESULT))
    return without.unionByName(within)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
