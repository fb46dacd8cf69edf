"""Structured Streaming jobs over activity files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmura.functions.text import entity_kind
from murmura.operators.enrich import english, with_tokens
from murmura.plans.ingest import Ingest
from murmura.schema import COUNT, TOKENS


def start_ingest(stream: DataFrame, job: Ingest, checkpoint: str,
                 interval: str | None = "60 seconds") -> StreamingQuery:
    """Run the ingest job on every non-empty micro-batch.

    With ``interval=None`` all files present are processed and the query ends. A
    batch repeated after a failure has the same id and replaces its own output.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            job.run(batch, batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def windowed_entity_counts(stream: DataFrame, width: str = "1 day", watermark: str = "7 days",
                           **tokens) -> DataFrame:
    """Entity counts per event-time window kept in Spark's own state.

    A window's counts are dropped when the watermark passes its end, which bounds
    the state; until then late posts still add to their window.
    """
    # A few files that cannot be split would be tokenized by as few tasks.
    tasks = stream.sparkSession.sparkContext.defaultParallelism
    spread = english(stream).repartition(tasks, "postedTime", "body")
    posts = with_tokens(spread, **tokens)
    terms = (posts.withColumn("posted_at", F.try_to_timestamp("postedTime"))
             .withWatermark("posted_at", watermark)
             .select("posted_at", F.explode_outer(TOKENS).alias("term"))
             .filter(F.col("term").isNotNull()))
    counted = (terms.groupBy(F.window("posted_at", width).alias("w"), "term")
               .agg(F.count("*").alias(COUNT)))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                          entity_kind("term").alias("kind"), "term", COUNT)


def start_counts(counts: DataFrame, path: str, checkpoint: str,
                 interval: str | None = "60 seconds") -> StreamingQuery:
    """Write each batch's changed counts; the highest batch holds the current value."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (counts.writeStream.outputMode("update").foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def current_counts(changes: DataFrame, *keys: str) -> DataFrame:
    """Latest value per key of a table written by ``start_counts``."""
    return changes.groupBy(*keys).agg(F.max_by(COUNT, "batch_id").alias(COUNT))
