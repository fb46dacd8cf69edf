"""Top-n reports and point lookups over counter tables.

``row_number() <= n`` is evaluated before the shuffle as well (window group
limit), so each task sends at most n rows of a group however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import entity_kind
from murmura.schema import COUNT, DATE


def top_n(df: DataFrame, groups: Sequence[str], n: int, by: str = COUNT,
          ties: Sequence[str] = ()) -> DataFrame:
    """The n largest rows per group with their 1-based ``rank``."""
    order = Window.partitionBy(*groups).orderBy(F.col(by).desc(), *[F.col(t).asc() for t in ties])
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_terms(counts: DataFrame, n: int, date: str | None = None,
              kinds: Sequence[str] = ("#", "@")) -> DataFrame:
    """Most used hashtags and handles, per date and kind."""
    picked = counts.filter(F.col("kind").isin(list(kinds)))
    if date:
        picked = picked.filter(F.col(DATE) == date)
    return (top_n(picked, [DATE, "kind"], n, ties=["term"])
            .select(DATE, "kind", "rank", "term", F.col(COUNT).alias("score")))


def term_count(counts: DataFrame, date: str, term: str) -> DataFrame:
    """One row with the term's count on a date, 0 if it was never seen."""
    term = term.lower()
    found = counts.filter((F.col(DATE) == date) & (F.col("term") == term)
                          & (F.col("kind") == entity_kind(F.lit(term))))
    return found.agg(F.coalesce(F.sum(COUNT), F.lit(0)).alias(COUNT)).select(
        F.lit(date).alias(DATE), F.lit(term).alias("term"), COUNT)


def term_counts(words: DataFrame, counts: DataFrame, date: str, word: str = "word") -> DataFrame:
    """Left join of words to a date's counts; words never counted get 0."""
    day = counts.filter(F.col(DATE) == date).select(F.col("term").alias(word), "kind", COUNT)
    keyed = words.withColumn("kind", entity_kind(word))
    return (keyed.join(day, [word, "kind"], "left")
            .withColumn(COUNT, F.coalesce(COUNT, F.lit(0))).drop("kind"))


def top_authors_for(counts: DataFrame, n: int, by: str = DATE) -> DataFrame:
    """Most active authors of every hashtag of a day."""
    return top_n(counts, [by, "hashtag"], n, ties=["author"])


def top_partners_for(pairs: DataFrame, n: int, by: str | None = DATE) -> DataFrame:
    """Most frequent partners of every token; ``pairs`` holds both directions."""
    return top_n(pairs, [by, "tok1"] if by else ["tok1"], n, ties=["tok2"])
