"""Joins and numberings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.runtime import materialize

HOT_ROWS = 200_000
HOT_KEYS = 500
"""A key with more than HOT_ROWS rows is hot; the HOT_KEYS largest are split off."""


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> list:
    """The keys that hold more than ``rows`` rows, at most HOT_KEYS of them.

    Which keys are called hot changes only how a join is carried out, so leaving a
    hot key beyond the bound to the ordinary join costs time, never rows.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    large = counts.filter(F.col("_rows") > rows)
    return [row[0] for row in large.orderBy(F.col("_rows").desc(), key).limit(HOT_KEYS).collect()]


def join_unique(big: DataFrame, side: DataFrame, key: str, how: str = "inner",
                hot: list | None = None) -> DataFrame:
    """Join ``big`` to a side with unique ``key``, splitting off hot keys.

    Rows of hot keys meet a broadcast of at most HOT_KEYS side rows and are never
    shuffled by the key; all other rows take the ordinary join. ``hot`` may be given
    when it is known, as in loops. Without hot keys one plain join is left.
    """
    hot = hot_keys(big, key) if hot is None else hot
    if not hot:
        return big.join(side, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = big.filter(~is_hot).join(side, key, how)
    few = F.broadcast(side.filter(F.col(key).isin(hot)))
    return rest.unionByName(big.filter(is_hot).join(few, key, how))


def with_global_order(
    df: DataFrame,
    order: Sequence[str],
    descending: Sequence[str] = (),
    number: str = "rank",
    running: dict[str, str] | None = None,
    label: str = "order",
) -> DataFrame:
    """Number rows 0, 1, ... in a total order without a single-partition window.

    Rows are range-partitioned by ``order`` (which should be unique), numbered
    inside their partition, and shifted by the totals of earlier partitions: one
    small row per partition. ``running`` maps a column to the name of its sum over
    all earlier rows.
    """
    running = running or {}
    keys = [F.col(c).desc() if c in descending else F.col(c).asc() for c in order]
    placed = materialize(
        df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)
    totals = placed.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in running])
    # One row per partition, so this window is small at any data size.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_{c}0") for c in running])
    inside = Window.partitionBy("_part").orderBy(*keys)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    shifted: list[Column] = [(F.col("_n0") + F.row_number().over(inside) - 1).alias(number)]
    shifted += [(F.col(f"_{c}0") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(name)
                for c, name in running.items()]
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, *shifted)
