"""First-fit decreasing packing with a tournament tree, in randomised groups.

A document's ids (with the end id) are cut into full pieces of ``capacity`` and one rest. Every
piece is dealt into a group by a seeded hash of its place in the input, which a repeated task
computes alike, so groups are random and equally large whatever the ids are: repeated doc_ids or
very long documents do not crowd one group. Each group packs its pieces on its own: pieces in
descending length, each into the first sequence with room, found by descending a tournament tree
of the free room. Groups hold about ``group_docs`` documents, or GROUP_BYTES of text if these are
longer, so a task's memory is bounded and
padding is small: only about one sequence per group stays ill-filled.

Sequences are padded to ``capacity``, except where their length is a power of two: those stay
as they are (``padded_length``).

Defined results: null and empty texts hold the end id alone; a null doc_id is kept as null; rows
that repeat a doc_id are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import ROWS_OUT, lists, table
from murmura.llm.encoding import KEEP, pieces, word_tokenizer_path

CAPACITY = 4096
GROUP_DOCS = 4_000
GROUP_BYTES = 16 << 20
"""Bytes of text of a group at most, on average."""
END_ID = 2
KEEP_WITH_IDS = 100_000
"""Pieces of a generation of a worker's memory where ids are handed on, less than elsewhere: groups
of ids are packed in the same workers. Groups without ids are a few MB."""
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pack_group long"
IDS = ", ids array<int>"


def cutter(path: str, end_id: int, capacity: int, groups: int, seed: int, with_ids: bool):
    """Arrow batches of (doc_id, text) to one row per piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, KEEP_WITH_IDS if with_ids else KEEP)
        end = np.array([end_id], "<u4").tobytes()
        task, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                doc_ids, rows, parts = [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    coded = known.encode(text) + end
                    total = len(coded) // 4
                    for start in range(0, total, capacity):
                        part = coded[4 * start:4 * (start + capacity)]
                        place = xxhash.xxh64_intdigest(f"{task}:{count}", seed)
                        count += 1
                        doc_ids.append(doc_id)
                        rows.append((start, len(part) // 4, zlib.crc32(part), total,
                                     place % groups))
                        parts.append(part)
                columns = [pa.array(doc_ids, pa.int64()),
                           *map(pa.array, np.array(rows, np.int64).reshape(-1, 5).T)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"]
                if with_ids:
                    columns.append(lists(np.frombuffer(b"".join(parts), "<i4"),
                                         np.array([r[1] for r in rows], np.int64)))
                    names.append("ids")
                yield pa.record_batch(columns, names)
    return cut


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the order given (descending lengths).

    ``room`` is a complete binary tree whose leaves are the bins' free room and whose inner
    nodes are the larger of their two children; the first bin with room is found by going left
    wherever the left child has enough.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "start", "ids_crc32"]
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable")
        bins, group["offset"] = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (group["pack_group"].to_numpy() << 32) + bins
        group["doc_id"] = group["doc_id"].astype("Int64")
        return group.drop(columns="pack_group")
    return pack


def padded_length(length: Column, capacity: int = CAPACITY) -> Column:
    """Length of a sequence as written: a power of two stays, all else is padded."""
    power = (length > 0) & (length.bitwiseAND(length - 1) == 0)
    return F.when(power, length).otherwise(F.lit(capacity))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
                   capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 11,
                   with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset there.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids``
    the piece's ids. ``group_docs`` sets how many documents a group holds on average; the
    number of groups follows the row count, and the bytes of text where texts are long.
    """
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-count // group_docs), -(-(size or 0) // GROUP_BYTES))
    cut = docs.select("doc_id", "text").mapInArrow(
        cutter(tokenizer or word_tokenizer_path(), end_id, capacity, groups, seed, with_ids),
        PIECE + IDS * with_ids)
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return (cut.groupBy("pack_group")
            .applyInPandas(packer(capacity),
                           out + IDS * with_ids + ", offset long, sequence_id long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
