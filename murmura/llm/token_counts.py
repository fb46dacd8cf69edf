"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded whole and aggregated by encoded length. Everything else is read from the
histogram: with n(l) documents of length l, sums over lengths above a limit give how many
documents a limit L cuts, and sum(min(l, L)) what is left of all tokens.

``length_histogram`` pre-aggregates in each task, so only (length, documents) pairs are
shuffled. ``context_limits`` turns it into one row per occurring length, taken as the limit.
The suffix sums run inside blocks of BLOCK lengths and over the blocks' totals.

Defined results: a null or empty text has length 0 (plus the end ids, if any are asked for);
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import table
from murmura.llm.encoding import pieces, word_tokenizer_path
from murmura.runtime import materialize

BLOCK = 1_024


def length_histogram(docs: DataFrame, tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    """tokens, n_docs: how many documents encode to each length (``extra``: ids added to each)."""
    path = tokenizer or word_tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = pieces(path), Counter()
        for batch in batches:
            lengths.update(len(known.encode(t)) // 4 + extra for t in batch.column(0).to_pylist())
        yield pa.record_batch([pa.array(list(lengths), pa.int64()),
                               pa.array(list(lengths.values()), pa.int64())], ["tokens", "n_docs"])

    return (docs.select("text").mapInArrow(count, "tokens long, n_docs long")
            .groupBy("tokens").agg(F.sum("n_docs").alias("n_docs")))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per length L of the histogram, as a context limit.

    context_limit, n_docs (of exactly this length), n_tokens (in those), docs_cut (longer than
    L), tokens_in_cut_docs, truncated_total (tokens left if every document is cut at L),
    total_docs, total_tokens, quantile (share of documents no longer than L).
    """
    rows = histogram.select(
        F.col("tokens").alias("context_limit"), "n_docs",
        (F.col("tokens") * F.col("n_docs")).alias("n_tokens"),
        F.floor(F.col("tokens") / BLOCK).alias("_block"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    # One row per BLOCK lengths: at most the longest document's length / BLOCK rows.
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"),
        F.sum("_d").over(every).alias("total_docs"), F.sum("_t").over(every).alias("total_tokens"))
    inside = (Window.partitionBy("_block").orderBy(F.desc("context_limit"))
              .rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumns({"_di": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
                            "_ti": F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))})
    cut = cut.join(F.broadcast(blocks), "_block").withColumns({
        "docs_cut": F.col("_d") + F.col("_di"), "tokens_in_cut_docs": F.col("_t") + F.col("_ti")})
    return cut.select(
        "context_limit", "n_docs", "n_tokens", "docs_cut", "tokens_in_cut_docs",
        (F.col("total_tokens") - F.col("tokens_in_cut_docs")
         + F.col("docs_cut") * F.col("context_limit")).alias("truncated_total"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_cut")) / F.col("total_docs")).alias("quantile"))


def length_at_quantile(limits: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return limits.filter(F.col("quantile") >= share).agg(F.min("context_limit").alias("tokens"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut at ``limit``, which need not be an occurring length."""
    shorter = F.col("context_limit") <= limit
    return limits.agg(F.coalesce(
        F.sum(F.when(shorter, F.col("n_tokens")).otherwise(F.col("n_docs") * limit)),
        F.lit(0)).alias("tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(table(spark, sf_dir, "documents"))
    # Written once: the limits read it twice, and each reading would encode all texts.
    return context_limits(materialize(histogram, "lengths"))
