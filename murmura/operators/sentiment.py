"""Sentiment lexicon and scoring of token arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.runtime import BROADCAST_ROWS, broadcast_if_small, within_rows
from murmura.schema import SENTIMENT, TOKENS

CUTOFF = 0.1


def lexicon_from_lines(lines: DataFrame) -> DataFrame:
    """Average scores per word from tab-separated sense lines in column ``value``.

    A line is ``pos, id, positive, negative, "word#1 word#2"``. Comments, blank
    lines and nouns are skipped; a word's senses are averaged.
    """
    line = F.trim(F.col("value"))
    parts = F.split(line, "\t")
    senses = (lines.filter((line != "") & ~line.startswith("#"))
              .select(parts[0].alias("pos"), parts[2].cast("double").alias("p"),
                      parts[3].cast("double").alias("n"), parts[4].alias("words"))
              .filter(F.col("pos") != "n")
              .select("p", "n", F.explode(F.split("words", " ")).alias("sense")))
    word = F.lower(F.substring_index("sense", "#", 1))
    return (senses.filter(F.contains("sense", F.lit("#")))
            .groupBy(word.alias("word"))
            .agg(F.avg("p").alias("positive"), F.avg("n").alias("negative"),
                 F.count("*").alias("senses")))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_from_lines(spark.read.text(path))


def _class_of(mean, cutoff: float):
    return (F.when(mean > cutoff, 1).when(mean < -cutoff, -1).otherwise(0)).cast("int")


def one_per_word(lexicon: DataFrame) -> DataFrame:
    """word, s: the mean of (positive - negative) over a word's rows."""
    return lexicon.groupBy("word").agg(F.avg(F.col("positive") - F.col("negative")).alias("s"))


def score_by_join(posts: DataFrame, lexicon: DataFrame, key: str, tokens: str = TOKENS,
                  cutoff: float = CUTOFF) -> DataFrame:
    """Score with joins only, for a lexicon of any size.

    Tokens are reduced to one (sum, hits) row per post before anything is joined
    back; posts without a hit stay and are neutral.
    """
    # Equal token sets have one score, so a digest of the set is the key: post ids may repeat
    # or be null. posexplode_outer: a plain one would push a copy of the token expression below.
    # Only tokens that the lexicon holds are grouped, never whole sets.
    digest = F.sha2(F.to_json(tokens), 256)
    words = posts.select(digest.alias("_set"), F.posexplode_outer(tokens).alias("_at", "word"))
    hits = (words.filter(F.col("word").isNotNull())
            .join(broadcast_if_small(one_per_word(lexicon)), "word")
            .groupBy("_set", "_at").agg(F.any_value("s").alias("s"))
            .groupBy("_set").agg(F.avg("s").alias("_mean")))
    posts = posts.withColumn("_key", digest)
    scored = posts.join(hits, F.col("_key") == F.col("_set"), "left")
    return (scored.withColumn(SENTIMENT, F.coalesce(_class_of(F.col("_mean"), cutoff), F.lit(0)))
            .drop("_mean", "_set", "_key"))


def score_by_lookup(posts: DataFrame, lexicon: DataFrame, tokens: str = TOKENS,
                    cutoff: float = CUTOFF) -> DataFrame:
    """Score against a small lexicon held by every task: no shuffle of the posts.

    Each Arrow batch is looked up as one flat token array, so there is no Python
    work per row.
    """
    words = one_per_word(lexicon).toArrow()
    spark = posts.sparkSession
    shared = spark.sparkContext.broadcast((
        words["word"].combine_chunks(), words["s"].combine_chunks().to_numpy(zero_copy_only=False)))

    @F.arrow_udf("int")
    def sentiment(toks: pa.Array) -> pa.Array:
        vocabulary, scores = shared.value
        rows = len(toks)
        owner = pc.list_parent_indices(toks).to_numpy()
        found = pc.index_in(pc.list_flatten(toks), value_set=vocabulary)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        values = scores[found.drop_null().to_numpy()] if len(scores) else np.zeros(0)
        owner = owner[hit]
        total = np.bincount(owner, weights=values, minlength=rows)
        count = np.bincount(owner, minlength=rows)
        mean = np.divide(total, count, out=np.zeros(rows), where=count > 0)
        return pa.array((mean > cutoff).astype(np.int32) - (mean < -cutoff).astype(np.int32))

    return posts.withColumn(SENTIMENT, sentiment(tokens))


def score_sentiment(posts: DataFrame, lexicon: DataFrame, key: str = "post_id",
                    tokens: str = TOKENS, cutoff: float = CUTOFF) -> DataFrame:
    """Add -1, 0 or 1: the mean of (positive - negative) over the lexicon hits.

    A post without a hit is neutral. A lexicon of checked size is looked up inside
    the tasks; a larger one is joined by ``key``.
    """
    if within_rows(lexicon, BROADCAST_ROWS):
        return score_by_lookup(posts, lexicon, tokens, cutoff)
    return score_by_join(posts, lexicon, key, tokens, cutoff)
