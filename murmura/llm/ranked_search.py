"""Exact ranked search over posting lists that are cut into blocks of similar documents.

Vectors. A document's coordinates are the impacts of its terms: the part of the score that does
not depend on the item, (1000000000 * tf) div (1000 * tf + 8 * m). Lists are made for the terms
that the items ask for.

Shards. Documents are ordered by the signs of a random projection of their vectors, which puts
similar ones side by side, and cut into shards of SHARD documents. A shard holds its documents'
vectors and its part of every posting list, so a common term's list is spread over all shards.

Blocks. Each list is clustered by itself: some of its documents stand for a block each, and every
other joins the one whose projection has the largest inner product with its own. A block stores
its documents and its summary, the coordinatewise maximum of their vectors. Coordinates that a
SHARED part of a shard's documents have are kept once for the shard, at their maximum there.

As lists are searched from rare to common terms, a block's summary only has the coordinates that
are as common as its own term or more so.

Search. An item's lists are read from the rarest term on. A document that no earlier list named
holds none of the earlier terms, so the remaining coordinates of a block's summary bound its score
from above; blocks whose bound is below the item's tenth best score so far are skipped, documents
of the others are scored in full. Once the rest of the lists together cannot reach the tenth best
score, the shard is done. Maxima are rounded up, so no bound is too low and results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import binary_rows, save_array, shared_folder_for, slices, table
from murmura.operators.skew import with_global_order
from murmura.runtime import materialize

ITEMS = 1_000
"""Items whose terms are indexed and searched together; more items take further passes."""
ITEM_BYTES = 1 << 20
"""Bytes of items of one pass, but for its last item."""
CELLS = 1 << 24
"""Documents times asked terms of a shard at most: long items make shards smaller."""
SHARD, BLOCK = 4_096, 256
"""Documents of a shard, and of a block at most."""
SHARDS_A_TASK = 8
"""Shards that a task makes and a file holds; a shard is some 10 MB."""
PLANES, SIGNS, SEED = 32, 16, 7
SHARED = 16
"""A coordinate that one in SHARED of a shard's documents have is kept once for the shard."""
STEP = 16
"""Maxima are rounded up to multiples of this, which fit 16 bits."""

# Fixed values of the ranking: maximal stretches of ASCII letters, digits and other characters.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms with repeats, in UTF-8."""
    return (text or "").encode().translate(SPLIT).split()


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def document_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written table: row, doc_id, n (terms with repeats), the vocabulary's terms and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes, terms, counts = [], [], []
            for text in batch.column(2).to_pylist():
                words = terms_of(text)
                own = sorted((vocabulary[t], c) for t, c in Counter(words).items()
                             if t in vocabulary)
                sizes.append(len(words))
                terms.append(np.array([t for t, _ in own], np.int32))
                counts.append(np.array([c for _, c in own], np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                                   binary_rows(terms), binary_rows(counts)],
                                  ["row", "doc_id", "n", "terms", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return materialize(rows.mapInArrow(
        run, "row long, doc_id long, n long, terms binary, counts binary"), "vectors")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents per term; each task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            held += np.bincount(terms, minlength=size)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], ["term", "df"])

    found = np.zeros(size, np.int64)
    for r in (vectors.select("terms").mapInArrow(run, "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):
        found[r.term] = r.df
    return found


def impacts(sizes: np.ndarray, ends: np.ndarray, counts: np.ndarray, total: int,
            words: int) -> np.ndarray:
    """Scores of terms before their weight, exact in 64-bit integers."""
    m = 100 - 75 + (75 * sizes * total) // max(words, 1)
    m = np.repeat(m, np.diff(ends))
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, PLANES)).astype(np.float32)


def project(terms: np.ndarray, values: np.ndarray, ends: np.ndarray, weights: np.ndarray,
            basis: np.ndarray) -> np.ndarray:
    """Random projections of weighted vectors to unit length, one row per document."""
    scaled = basis[terms] * (values * weights[terms]).astype(np.float32)[:, None]
    sums = np.zeros((len(ends) - 1, basis.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        sums[some] = np.add.reduceat(scaled, ends[some], axis=0)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def unpacked(batch: pa.RecordBatch, terms: int, counts: int):
    """Flat terms, flat counts and row bounds of packed vectors."""
    parts = batch.column(terms).to_pylist()
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    return (np.frombuffer(b"".join(parts), np.int32),
            np.frombuffer(b"".join(batch.column(counts).to_pylist()), np.int32).astype(np.int64),
            ends)


def cut_list(docs: np.ndarray, around: np.ndarray) -> list[np.ndarray]:
    """A posting list in blocks of at most BLOCK documents, clustered around some of its own."""
    if len(docs) <= BLOCK:
        return [docs]
    places = around[docs]
    chosen = places[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
    nearest = np.argmax(places @ chosen.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    bounds = np.flatnonzero(np.diff(nearest[order])) + 1
    return [part[at:at + BLOCK] for part in np.split(docs[order], bounds)
            for at in range(0, len(part), BLOCK)]


class Shard:
    """Vectors, blocks and summaries of some documents, as flat arrays."""

    FIELDS = (("doc_ids", np.int64), ("rows", np.int64), ("ends", np.int64), ("terms", np.int32),
              ("values", np.int32), ("block_terms", np.int32), ("block_ends", np.int64),
              ("block_docs", np.int32), ("summary_ends", np.int64), ("summary_places", np.int32),
              ("summary_tops", np.uint16), ("shared_terms", np.int32), ("shared_tops", np.int32))

    @classmethod
    def build(cls, doc_ids, rows, ends, terms, values, weights, basis, turn) -> Shard:
        """``turn``: each term's place in the order from rare to common."""
        self = cls()
        self.doc_ids, self.rows, self.ends = doc_ids, rows, ends
        self.terms, self.values = terms, values.astype(np.int32)
        count = len(doc_ids)
        known, column = np.unique(terms, return_inverse=True)
        held = np.repeat(np.arange(count), np.diff(ends))
        df = np.bincount(column, minlength=len(known))
        tops = np.zeros(len(known), np.int32)
        np.maximum.at(tops, column, self.values)
        shared = df * SHARED >= count
        self.shared_terms, self.shared_tops = known[shared], tops[shared]
        own = np.flatnonzero(~shared)
        place = np.full(len(known), -1)
        place[own] = np.arange(len(own))
        dense = np.zeros((count, len(own)), np.uint16)
        kept = place[column] >= 0
        dense[held[kept], place[column[kept]]] = -(-self.values[kept] // STEP)
        around = project(terms, values, ends, weights, basis)
        order = np.argsort(column, kind="stable")
        starts = np.concatenate([[0], np.cumsum(df)])
        block_terms, blocks, summary_places, summary_tops = [], [], [], []
        later = turn[known[own]]
        for i, term in enumerate(known):
            for block in cut_list(held[order[starts[i]:starts[i + 1]]], around):
                summary = dense[block].max(axis=0)
                some = np.flatnonzero((summary > 0) & (later >= turn[term]))
                block_terms.append(term)
                blocks.append(block)
                summary_places.append(own[some])
                summary_tops.append(summary[some])
        self.block_terms = np.array(block_terms, np.int32)
        self.block_ends = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        self.block_docs = np.concatenate([np.zeros(0, np.int32), *blocks])
        self.summary_ends = np.concatenate([[0], np.cumsum([len(b) for b in summary_places])])
        self.summary_places = np.concatenate([np.zeros(0, np.int64), *summary_places])
        self.summary_tops = np.concatenate([np.zeros(0, np.uint16), *summary_tops])
        return self

    def packed(self) -> bytes:
        """All arrays behind each other, after their lengths in bytes; compressed."""
        parts = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.FIELDS]
        sizes = np.array([p.nbytes for p in parts], np.int64)
        return zstandard.ZstdCompressor(level=1).compress(
            b"".join([sizes.tobytes(), *(p.tobytes() for p in parts)]))

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        self, data = cls(), zstandard.ZstdDecompressor().decompress(data)
        at = 8 * len(cls.FIELDS)
        for (name, kind), size in zip(cls.FIELDS, np.frombuffer(data, np.int64, len(cls.FIELDS))):
            setattr(self, name, np.frombuffer(data[at:at + size], kind))
            at += int(size)
        return self

    def open(self) -> None:
        """Lay out vectors and summaries by column, for any item."""
        self.known, column = np.unique(self.terms, return_inverse=True)
        count = len(self.doc_ids)
        self.vectors = np.zeros((count, len(self.known)), np.int32)
        self.vectors[np.repeat(np.arange(count), np.diff(self.ends)), column] = self.values
        self.tops = np.zeros((len(self.block_terms), len(self.known)), np.uint16)
        at = np.repeat(np.arange(len(self.block_terms)), np.diff(self.summary_ends))
        self.tops[at, self.summary_places] = self.summary_tops
        self.tops[:, np.searchsorted(self.known, self.shared_terms)] = -(-self.shared_tops // STEP)
        self.most = self.vectors.max(axis=0, initial=0).astype(np.int64)
        # Blocks of a list are neighbours, and lists stand in the order of their terms.
        self.first = np.searchsorted(self.block_terms, self.known, "left")
        self.last = np.searchsorted(self.block_terms, self.known, "right")

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> tuple[int, int]:
        """Offer every document that may be among the best; blocks met and blocks skipped.

        ``terms`` stand from the rarest on; ``weights`` hold their repeats in the item.
        """
        if not len(self.known):
            return 0, 0
        place = np.searchsorted(self.known, terms)
        here = (place < len(self.known)) & (self.known[np.minimum(place, len(self.known) - 1)]
                                            == terms)
        columns, weights = place[here], weights[here]
        left = np.cumsum((weights * self.most[columns])[::-1])[::-1]
        seen = np.zeros(len(self.doc_ids), bool)
        met = skipped = 0
        for i, c in enumerate(columns):
            if left[i] < best.floor:
                skipped += int(np.sum(self.last[columns[i:]] - self.first[columns[i:]]))
                break
            rest, w = columns[i:], weights[i:]
            bounds = STEP * (self.tops[self.first[c]:self.last[c]][:, rest].astype(np.int64) @ w)
            wanted = self.first[c] + np.flatnonzero(bounds >= best.floor)
            met += len(bounds)
            skipped += len(bounds) - len(wanted)
            if not len(wanted):
                continue
            docs = np.concatenate([self.block_docs[self.block_ends[b]:self.block_ends[b + 1]]
                                   for b in wanted])
            docs = docs[~seen[docs]]
            seen[docs] = True
            best.offer(self.vectors[docs][:, columns].astype(np.int64) @ weights,
                       self.doc_ids[docs], self.rows[docs])
        return met, skipped


NO_ID = np.iinfo(np.int64).max
"""Stands for a null doc_id while documents are ranked: it comes last among equal scores."""


class Best:
    """The ``k`` best of the documents offered so far: by score, then doc_id, then row."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1  # scores of 0 and less are no results
        self.found = [np.zeros(0, np.int64)] * 3

    def offer(self, scores: np.ndarray, doc_ids: np.ndarray, rows: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        both = [np.concatenate([a, b[good]])
                for a, b in zip(self.found, (scores, doc_ids, rows))]
        order = np.lexsort((both[2], both[1], -both[0]))[:self.k]
        self.found = [a[order] for a in both]
        if len(order) == self.k:
            self.floor = max(1, int(self.found[0][-1]))


def build_index(vectors: DataFrame, df: np.ndarray, total: int, words: int) -> DataFrame:
    """Shards as files of the shared folder, and a written table of their paths: file, documents.

    A file holds one shard, some 5 MB, which a task reads when it comes to search it; a repeated
    task writes its files anew under the same names.
    """
    spark = vectors.sparkSession
    folder = shared_folder_for(spark, "search")
    weights = np.array([weight(total, int(x)) for x in df], np.int64)
    turn = np.empty(len(df), np.int64)
    turn[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = planes(len(weights))
        powers = 1 << np.arange(SIGNS)[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                terms, counts, ends = unpacked(part, 3, 4)
                values = impacts(part.column(2).to_numpy(), ends, counts, total, words)
                signs = project(terms, values, ends, weights, basis)[:, :SIGNS] > 0
                yield pa.record_batch([*part.columns, pa.array((signs @ powers).astype(np.int64))],
                                      [*part.schema.names, "code"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, waiting, held, made = planes(len(weights)), [], 0, 0
        task = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            terms, counts, ends = unpacked(rows, 3, 4)
            values = impacts(rows.column(2).to_numpy(), ends, counts, total, words)
            ids = rows.column(1).fill_null(NO_ID).to_numpy()
            built = Shard.build(ids, rows.column(0).to_numpy(), ends, terms, values, weights,
                                basis, turn)
            path = f"{folder}/shard-{task}-{made}"
            save_array(path, np.frombuffer(built.packed(), np.uint8))
            return pa.record_batch([pa.array([path]), pa.array([len(ids)], pa.int64())],
                                   ["file", "documents"])

        for batch in batches:
            while batch.num_rows:
                waiting.append(batch.slice(0, size - held))
                held += waiting[-1].num_rows
                batch = batch.slice(waiting[-1].num_rows)
                if held == size:
                    yield shard()
                    waiting, held, made = [], 0, made + 1
        if held:
            yield shard()

    size = max(16, min(SHARD, CELLS // max(len(df), 1)))
    tasks = max(spark.sparkContext.defaultParallelism,
                -(-total // (size * SHARDS_A_TASK)))
    # The row settles ties, so that many equal vectors are dealt over several tasks.
    coded = vectors.filter(F.octet_length("terms") > 0).mapInArrow(
        codes, "row long, doc_id long, n long, terms binary, counts binary, code long")
    placed = (coded.repartitionByRange(tasks, "code", "row")
              .sortWithinPartitions("code", "row"))
    return materialize(placed.mapInArrow(shards, "file string, documents long"), "shards")


def search_index(index: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]],
                 k: int) -> DataFrame:
    """The ``k`` best rows of each task for each item: item, doc_id, row, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as file:
                    shard = Shard.unpacked(file.read())
                shard.open()
                for (_, terms, weights), own in zip(asked, best):
                    shard.search(terms, weights, own)
        counts = [len(b.found[0]) for b in best]
        scores, ids, rows = (np.concatenate([b.found[i] for b in best]) for i in range(3))
        yield pa.record_batch([
            pa.array(np.repeat([a[0] for a in asked], counts)),
            pa.array(ids, mask=ids == NO_ID), pa.array(rows), pa.array(scores)],
            ["item", "doc_id", "row", "score"])

    spark, shards = index.sparkSession, index.count()
    tasks = max(spark.sparkContext.defaultParallelism, -(-shards // SHARDS_A_TASK))
    return index.repartition(tasks, "file").mapInArrow(
        run, "item long, doc_id long, row long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    Defined results: a null or empty text has no terms and is found by, or finds, nothing; a null
    doc_id comes last among equal scores, rows with the same doc_id in the table's order; every
    row is an item or a document of its own, also repeated ones; an empty table gives no rows;
    other columns are ignored. The items go round in blocks of ITEMS and ITEM_BYTES, whose terms
    alone the driver and the tasks hold; a document's vector has at most that many coordinates,
    however long its text.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    numbered = with_global_order(
        items.select("item_id", "text", size.alias("_size"),
                     F.monotonically_increasing_id().alias("_row")),
        ["_row"], number="item", running={"_size": "_before"}, label="items")
    asked = materialize(numbered.select(
        "item_id", "text", "item", F.struct(F.floor(F.col("item") / ITEMS).alias("i"),
                                            F.floor(F.col("_before") / ITEM_BYTES).alias("b"))
        .alias("turn")), "items")
    turns = [r.turn for r in asked.select("turn").distinct().collect()]
    rounds = [_rank_block(docs, asked.filter((F.col("turn.i") == t.i) & (F.col("turn.b") == t.b)),
                          k) for t in turns]
    schema = "item_id long, rank int, doc_id long, score long"
    return reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], schema)


def _rank_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    bags = []
    for r in block.select("item", "text").collect():
        bags.append((r.item, Counter(vocabulary.setdefault(t, len(vocabulary))
                                     for t in terms_of(r.text))))
    vectors = document_vectors(docs, vocabulary)
    total, words = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = document_frequencies(vectors, len(vocabulary))
    asked = []
    for item, bag in bags:
        rare_first = sorted((t for t in bag if df[t]), key=lambda t: (df[t], t))
        if rare_first:
            asked.append((item, np.array(rare_first), np.array(
                [bag[t] * weight(total, int(df[t])) for t in rare_first], np.int64)))
    if not asked:
        return docs.sparkSession.createDataFrame(
            [], "item_id long, rank int, doc_id long, score long")
    found = search_index(build_index(vectors, df, total, words or 0), asked, k)
    falling = Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return (found.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= k)
            .join(F.broadcast(block.select("item", "item_id")), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
t AS (SELECT doc_id, unnest(terms) AS term FROM d),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE)
                                        / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM c, a GROUP BY term),
i AS (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT item_id, doc_id,
             CAST(sum(times * w * ((1000000000 * tf)
                  // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN c USING (term) JOIN s USING (doc_id), a
      GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
