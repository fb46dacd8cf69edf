"""From raw activity records to posts with date, token set and sentiment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import text as tx
from murmura.functions.tweet_tokens import tweet_tokens
from murmura.operators.sentiment import score_sentiment
from murmura.schema import AUTHOR, DATE, TOKENS

Tokenizer = Callable[[Column], Column]


def with_post_id(activities: DataFrame) -> DataFrame:
    """The record's id, or a digest of its content where it has none."""
    if "post_id" in activities.columns:
        return activities
    digest = F.sha2(F.concat_ws("\x1f", "actor.preferredUsername", "postedTime", "verb", "body"), 256)
    return activities.withColumn("post_id", F.coalesce("id", digest))


def english(activities: DataFrame, language: str = "en") -> DataFrame:
    return activities.filter(F.col("twitter_lang") == language)


def with_tokens(
    activities: DataFrame,
    stop_words: Iterable[str] | None = None,
    suffixes: Sequence[str] = tx.SUFFIXES,
    legacy_numbers: bool = False,
    tokenizer: Tokenizer = tweet_tokens,
    numbers: bool = False,
    tags_only: bool = False,
) -> DataFrame:
    """Add the post's date and the distinct clean tokens of its own and shared text.

    With ``tags_only`` just hashtags and handles: no other token is cut or lowered to one, so the
    rest goes before it is cleaned.
    """
    stop_words = tx.default_stop_words() if stop_words is None else stop_words

    # Repeats go before cleaning, so that each different token is examined once.
    texts = [tokenizer(F.col("body")), tokenizer(F.col("object.body"))]
    if tags_only:
        texts = [tx.tags_and_handles(tokens) for tokens in texts]
    found = tx.token_set(*texts, min_length=0)
    cleaned = tx.clean_tokens(found, stop_words, suffixes, numbers, legacy_numbers, min_length=2)
    return activities.withColumns({
        DATE: tx.post_date("postedTime"),
        TOKENS: F.array_distinct(cleaned),
    })


def enrich_posts(
    activities: DataFrame,
    lexicon: DataFrame,
    stop_words: Iterable[str] | None = None,
    suffixes: Sequence[str] = tx.SUFFIXES,
    legacy_numbers: bool = False,
    tokenizer: Tokenizer = tweet_tokens,
    language: str = "en",
) -> DataFrame:
    """Posts in one language with ``postedDate``, ``toks`` and ``sentiment``.

    Everything is computed inside the scan's stage; no row is shuffled.
    """
    posts = with_tokens(english(with_post_id(activities), language), stop_words, suffixes,
                        legacy_numbers, tokenizer)
    return score_sentiment(posts, lexicon)


def exclude_bodies(posts: DataFrame, patterns: Iterable[str] = tx.EXCLUDED_BODIES) -> DataFrame:
    """Drop posts whose body holds one of the patterns, and posts without a body."""
    patterns = list(patterns)
    if not patterns:
        return posts.filter(F.col("body").isNotNull())
    # A plain text is searched for as bytes, much faster than by a pattern.
    plain = [p for p in patterns if re.fullmatch(r"[\w#@ ]+", p)]
    others = [p for p in patterns if p not in plain]
    found = [F.contains("body", F.lit(p)) for p in plain]
    if others:
        found.append(F.col("body").rlike("|".join(others)))
    return posts.filter(~reduce(lambda a, b: a | b, found))


def token_table(posts: DataFrame) -> DataFrame:
    """``verb, postedDate, AU, toks`` of enriched posts."""
    keys = ["post_id"] if "post_id" in posts.columns else []
    return posts.select(*keys, "verb", DATE, F.col("actor.preferredUsername").alias(AUTHOR), TOKENS)


def share_slice(posts: DataFrame, start: str | None = None, end: str | None = None,
                inclusive: bool = False) -> DataFrame:
    """Shares as ``post_id, uid, ouid, body, toks, sentiment``; dates prune partitions."""
    if start or end:
        posts = slice_dates(posts, start, end, inclusive)
    return (posts.filter(F.col("verb") == "share")
            .select("post_id", F.col("actor.preferredUsername").alias("uid"),
                    F.col("object.actor.preferredUsername").alias("ouid"),
                    F.col("object.body").alias("body"), TOKENS, "sentiment"))


def slice_dates(posts: DataFrame, start: str | None = None, end: str | None = None,
                inclusive: bool = False, column: str = DATE) -> DataFrame:
    """Rows with ``start <= date < end``, or ``<= end`` if inclusive."""
    date = F.col(column)
    if start:
        posts = posts.filter(date >= start)
    if end:
        posts = posts.filter(date <= end if inclusive else date < end)
    return posts


def filter_terms(posts: DataFrame, terms: str | Iterable[str], tokens: str = TOKENS) -> DataFrame:
    """Posts with at least one of the terms as a whole token."""
    terms = tx.parse_terms(terms)
    return posts.filter(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms])))


def filter_topic(posts: DataFrame, terms: Iterable[str], column: str = "body") -> DataFrame:
    """Posts whose text has one of the terms between blanks, in any case."""
    choice = "|".join(rf"\Q{t}\E" for t in terms)
    return posts.filter(F.col(column).rlike(f"(?i) ({choice}) "))
