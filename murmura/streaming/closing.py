"""Final counts of closed windows, posts that came too late, and groups that nobody updates."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from murmura.schema import COUNT, DATE
from murmura.sources.counter_store import UPDATED, expire_store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EXPIRED = f"{DATE} string, kind string, {UPDATED} timestamp, expired_at timestamp"


def _start(rows: DataFrame, on_batch, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Append-mode query with its state in RocksDB; ``interval=None`` ends after all files."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = (rows.writeStream.outputMode("append").foreachBatch(on_batch)
                  .option("checkpointLocation", checkpoint))
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()
    finally:
        spark.conf.set(PROVIDER, before)


def start_closed(counts: DataFrame, path: str, checkpoint: str,
                 interval: str | None = "60 seconds") -> StreamingQuery:
    """Write each window of ``windowed_entity_counts`` once, when the watermark passes its end.

    Rows that come for a closed window are dropped by Spark; ``late_counts`` tells what they were.
    A batch that is repeated replaces its own folder.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(counts, on_batch, checkpoint, interval)


def read_closed(spark: SparkSession, path: str) -> DataFrame:
    """Final counts of the days that are closed."""
    return spark.read.parquet(path).select(
        F.date_format("start", "yyyy-MM-dd").alias(DATE), "kind", "term", COUNT)


def late_counts(everything: DataFrame, closed: DataFrame) -> DataFrame:
    """Counts of closed days: those in time, and those that came after their day was closed.

    ``everything`` counts all posts, as the counter store does. All days up to the newest closed
    one are closed; a term used by late posts alone has the count 0.
    """
    newest = closed.agg(F.max(DATE)).scalar()
    keys = [DATE, "kind", "term"]
    known = closed.withColumnRenamed(COUNT, "_closed")
    return (everything.filter(F.col(DATE) <= newest).join(known, keys, "left")
            .select(*keys, F.coalesce("_closed", F.lit(0).cast("long")).alias(COUNT),
                    (F.col(COUNT) - F.coalesce("_closed", F.lit(0))).alias("late")))


class _LastUpdate(StatefulProcessor):
    """One number per (date, kind): when it was last updated, with a timer set by it."""

    def __init__(self, days: int):
        self.keep_ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part[UPDATED].max().value) // 1000 for part in rows)
        if self.last.exists():
            newest = max(newest, int(self.last.get()[0]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest,))
        # A group still counts at the very end of its time, hence one millisecond more.
        self.handle.registerTimer(-(-newest // 1000) + self.keep_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield pd.DataFrame({
            DATE: [key[0]], "kind": [key[1]],
            UPDATED: [datetime.fromtimestamp(last / 1e6, timezone.utc).replace(tzinfo=None)],
            "expired_at": [datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1e3, timezone.utc)
                           .replace(tzinfo=None)]})

    def close(self) -> None:
        pass


def _newest_per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (date, kind) and Arrow batch, so a day with most rows is small before it moves."""
    for batch in batches:
        if batch.num_rows:
            newest = pa.Table.from_batches([batch]).group_by([DATE, "kind"]).aggregate(
                [(UPDATED, "max")]).rename_columns([DATE, "kind", UPDATED])
            yield from newest.select([DATE, "kind", UPDATED]).to_batches()


def expired_groups(updates: DataFrame, days: int = 7, delay: str = "1 hour") -> DataFrame:
    """(date, kind) groups of a stream of counts whose last update is more than ``days`` old.

    The state is one time per group that lives, whatever the number of its terms, and goes with
    the group. Time is that of the updates: it moves on as new ones come. Updates that are more
    than ``delay`` older than the newest are not looked at.
    """
    narrow = updates.select(DATE, "kind", UPDATED).filter(F.col(UPDATED).isNotNull())
    groups = narrow.mapInArrow(_newest_per_group, narrow.schema).withWatermark(UPDATED, delay)
    return groups.groupBy(DATE, "kind").transformWithStateInPandas(
        _LastUpdate(days), EXPIRED, "Append", "EventTime")


def store_updates(spark: SparkSession, store: str) -> DataFrame:
    """The batches of a counter store that is split by date, as a stream."""
    schema = spark.read.parquet(f"{store}/schema").schema.add("batch_id", "long")
    return spark.readStream.schema(schema).parquet(f"{store}/batches")


def start_expiry(spark: SparkSession, store: str, checkpoint: str, days: int = 7,
                 delay: str = "1 hour", interval: str | None = "60 seconds") -> StreamingQuery:
    """Follow a counter store and remove the groups whose timers fire, folders included."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        due = batch.agg(F.max("expired_at")).first()[0]
        if due is not None:
            expire_store(batch.sparkSession, store, due, days)

    return _start(expired_groups(store_updates(spark, store), days, delay), on_batch, checkpoint,
                  interval)
