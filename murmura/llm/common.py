"""Helpers shared by the operators: tables, shared folders, flat arrays, Arrow columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from murmura.runtime import scratch_path

ROWS_OUT = 2_000
"""Rows of one Arrow batch that a task hands back, so that long texts stay in small batches."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mounted(uri: str) -> str:
    """The path under which every machine sees a shared folder. Memory mapping needs one."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped arrays need a shared folder that is mounted "
                         "on every executor; set spark.checkpoint.dir to one")
    return parts.path


def shared_folder_for(spark: SparkSession, label: str) -> str:
    """A new folder for flat arrays below ``spark.checkpoint.dir``, as a mounted path."""
    path = mounted(scratch_path(spark, label))
    os.makedirs(path, exist_ok=True)
    return path


def save_array(path: str, values: np.ndarray) -> None:
    """Write a flat array under its final name at once; a repeated task replaces its own file."""
    part = f"{path}.{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, path)


def map_array(path: str, dtype) -> np.ndarray:
    """A saved array, memory-mapped; a missing or empty file is an empty array."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, dtype)
    return np.memmap(path, dtype, "r")


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column of the given lengths over one flat array."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column without nulls, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[ends[0]:ends[-1]], ends - ends[0]


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, summed by Spark."""
    from pyspark.sql import functions as F
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def slices(batches: Iterator[pa.RecordBatch], column: int,
           limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of a text column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, at + ROWS_OUT)
            yield batch.slice(at, stop - at)
            at = stop


def binary_rows(values: list[np.ndarray]) -> pa.Array:
    """Flat arrays as one binary column."""
    return pa.array([v.tobytes() for v in values], pa.binary())
