"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id.

``write_token_ids`` range-partitions the texts by doc_id (texts, not ids, cross the network),
encodes each sorted partition and writes one ORC file per partition. A file holds ``doc_id``,
``row`` (its position in the file), ``n_tokens`` and ``ids``. Spark's reader takes the stripes
in parallel; a filter on doc_id skips stripes and row groups by their ranges and Bloom filters
(``find_documents``).

``token_index`` reads the files back and gives each document's place in the whole id stream.
Files follow each other by their number, which is the order of doc_id.

Defined results: null text counts as empty and yields the end id alone; a null doc_id comes
first; rows with the same doc_id all stay, ordered by a hash of the text, so that the sample that
finds the ranges holds no texts, then by text; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import ROWS_OUT, flat, lists, table
from murmura.llm.encoding import pieces, word_tokenizer_path
from murmura.runtime import scratch_path

FILE_SCHEMA = "doc_id long, row int, n_tokens int, ids array<int>"
END_ID = 1


def encoder(path: str, end_id: int):
    """Arrow batches of (doc_id, text) to batches of FILE_SCHEMA."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, row = pieces(path), np.array([end_id], "<u4").tobytes(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                coded = [known.encode(text) + end for text in batch.column(1).to_pylist()]
                sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                ids = np.frombuffer(b"".join(coded), "<i4")
                rows = np.arange(row, row + len(coded), dtype=np.int32)
                row += len(coded)
                yield pa.record_batch(
                    [batch.column(0), pa.array(rows), pa.array(sizes.astype(np.int32)),
                     lists(ids, sizes)], ["doc_id", "row", "n_tokens", "ids"])
    return encode


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None,
                    end_id: int = END_ID, row_group: int = 1_000,
                    stripe_bytes: int = 32 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending doc_id order."""
    tie = F.xxhash64("text")
    ordered = (docs.select("doc_id", "text").repartitionByRange("doc_id", tie)
               .sortWithinPartitions("doc_id", tie, "text"))
    (ordered.mapInArrow(encoder(tokenizer or word_tokenizer_path(), end_id), FILE_SCHEMA)
     .write.option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_group))
     .option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes and row groups without them are not read."""
    return read_token_ids(spark, path).filter(F.col("doc_id").isin(doc_ids))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ends = flat(batch.column("ids"))
        data = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.record_batch(
            [batch.column("part"), batch.column("row"), batch.column("doc_id"),
             pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            ["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files.

    The totals of the files (one row each) are summed in order and sent to the rows, so the
    running sum is taken inside each file only.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    files = read_token_ids(spark, path).withColumn("part", number)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_at"))
    rows = files.select("part", "row", "doc_id", "ids").mapInArrow(
        checksums, "part int, row int, doc_id long, n_tokens long, ids_crc32 long")
    before = (Window.partitionBy("part").orderBy("row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("_at") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
