"""User-facing reports: top terms, related terms, communities and their details.

Each returns DataFrames. The ``*_json`` helpers give the documented answer formats;
answers that grow with the data are one JSON line per element, written by the
executors, and never one document held in a single task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions import text as tx
from murmura.operators import enrich, graph, ranking, vectors
from murmura.operators.layout import layout
from murmura.runtime import at_once, materialize
from murmura.schema import COUNT, DATE, TOKENS
from murmura.sources import registry
from murmura.sources.tables import read_table


# --- slices ------------------------------------------------------------------

def load_slice(spark: SparkSession, posts_root: str, start: str, end: str) -> DataFrame:
    """Shares of ``[start, end)`` from the posts table, kept for repeated queries."""
    return enrich.share_slice(read_table(spark, posts_root), start, end).persist()


# --- top terms ---------------------------------------------------------------

def top_terms_json(top: DataFrame) -> DataFrame:
    """One answer per date from ``ranking.top_terms``; it holds n terms per kind."""
    def listed(kind: str) -> Column:
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "term", "score")))
        return F.transform(F.array_sort(rows), lambda r: F.struct(
            r["term"].alias("term"), r["score"].alias("score")))

    answer = F.struct(F.lit(True).alias("success"), F.lit(0).alias("status"),
                      F.col("hashtags"), F.col("handles"))
    return (top.groupBy(DATE).agg(listed("#").alias("hashtags"), listed("@").alias("handles"))
            .select(DATE, F.to_json(answer).alias("response")))


# --- related terms -------------------------------------------------------------

def related_terms(words: DataFrame, counts: DataFrame, date: str, term: str, n: int,
                  only: str | None = "#") -> DataFrame:
    """``word, similarity, count`` of the n closest words, closest first."""
    found = vectors.related_terms(words, term, n, only)
    counted = ranking.term_counts(found, counts, date)
    return counted.select("word", "similarity", COUNT).orderBy(F.col("similarity").desc(), "word")


def related_terms_json(related: DataFrame, term: str, term_count: DataFrame) -> DataFrame:
    """The one-row JSON answer; an unknown term has an empty list."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "word", COUNT)))
    listed = F.transform(items, lambda r: F.array(
        r["word"], (-r["order"]).cast("string"), r[COUNT].cast("string")))
    count = term_count.select(COUNT).scalar()
    answer = F.struct(F.lit(True).alias("success"), F.lit(0).alias("status"),
                      F.lit(term).alias("searchTerm"), count.alias("searchTermCount"),
                      F.col("distance"))
    return related.agg(listed.alias("distance")).select(F.to_json(answer).alias("response"))


# --- communities ----------------------------------------------------------------

@dataclass(frozen=True)
class Communities:
    """Kept nodes ``label, id, degree, community, x, y, z`` and edges between them."""

    query_key: str
    nodes: DataFrame
    edges: DataFrame

    def membership(self) -> DataFrame:
        return self.nodes.select(F.col("label").alias("uid"), "community")

    def save(self, root: str, now: datetime) -> None:
        """Store the members under the query key, replacing older ones."""
        registry.save_membership(root, self.query_key,
                                 self.nodes.select(F.col("label").alias("id"), "community"), now)


def key_of(spark: SparkSession, terms: str | Iterable[str]) -> str:
    joined = ",".join(tx.parse_terms(terms))
    return spark.range(1).select(tx.query_key(joined)).first()[0]


def communities(shares: DataFrame, terms: str | Iterable[str], get3d: bool = False,
                resolution: float = 1.0, k: int | None = None, coverage: float = 0.9,
                with_layout: bool = True, layout_rounds: int = 300) -> Communities:
    """Communities among users who shared posts with one of the terms.

    Shares with a term become weighted edges; the 2-core is split into communities,
    the largest are kept and placed in two or three dimensions.
    """
    # Kept, because every step over lazy edges would tokenize the posts again.
    edges = materialize(graph.share_edges(enrich.filter_terms(shares, terms)), "edges")
    core = graph.k_core(edges, 2)
    steps = [lambda: materialize(graph.communities(core, resolution), "labels")]
    if with_layout:
        steps.append(lambda: layout(core, 3 if get3d else 2, layout_rounds))
    labels, *placed = at_once(shares.sparkSession, *steps)
    coords = placed[0] if placed else None
    points, lines = graph.community_graph(core, labels, coords, k,
                                          None if k is not None else coverage)
    return Communities(key_of(shares.sparkSession, terms), materialize(points, "points"),
                       materialize(lines, "lines"))


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c.cast("string")))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _line(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def community_nodes_json(nodes: DataFrame) -> DataFrame:
    """One JSON array per node: label, id, degree, community, x, y, z."""
    return nodes.select(_line(
        _quoted(F.col("label")), _quoted(F.col("id")), F.col("degree").cast("string"),
        _quoted(F.col("community")), *[F.col(c).cast("string") for c in ("x", "y", "z")])
        .alias("value"))


def community_edges_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON array per edge: target's label, source id, target id, weight."""
    ids = nodes.select(F.col("label"), F.col("id"))
    joined = (edges
              .join(ids.select(F.col("label").alias("source"), F.col("id").alias("s")), "source")
              .join(ids.select(F.col("label").alias("target"), F.col("id").alias("t")), "target"))
    return joined.select(_line(*[_quoted(F.col(c)) for c in ("target", "s", "t", "weight")])
                         .alias("value"))


def community_details(shares: DataFrame, terms: str | Iterable[str], membership: DataFrame,
                      n: int, side: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Sentiment counts and the n most used words of every community."""
    posts = materialize(
        graph.community_posts(enrich.filter_terms(shares, terms), membership, side)
        .select("post_id", "community", TOKENS, "sentiment"), "details")
    return graph.community_sentiment(posts), graph.community_wordcloud(posts, n)


def community_details_json(sentiment: DataFrame, words: DataFrame) -> DataFrame:
    """One answer per community: sentiment triple and at most n word counts."""
    cloud = words.groupBy("community").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word", COUNT))),
        lambda r: F.struct(r["word"].alias("word"), r[COUNT].alias("count"))).alias("wordcloud"))
    both = sentiment.join(cloud, "community", "left")
    triple = F.array("positive", "negative", "neutral").alias("sentiment")
    return both.select("community", F.to_json(F.struct(triple, "wordcloud")).alias("response"))


# --- a topic from first term to word clouds ---------------------------------------

@dataclass(frozen=True)
class TopicStory:
    """What a topic's shares look like: terms, members with places, mood, words."""

    terms: DataFrame
    members: DataFrame
    sentiment: DataFrame
    words: DataFrame


def topic_story(shares: DataFrame, words: DataFrame, term: str, terms: int = 20,
                resolution: float = 1.0, coverage: float = 0.9, layout_rounds: int = 100,
                top: int = 50, stop_words: Iterable[str] = ()) -> TopicStory:
    """Curate a topic, find its communities, place them and describe each.

    ``shares`` has ``uid, ouid, body, sentiment``; ``words`` are term vectors.
    """
    topic = materialize(vectors.curate_topic(words, term, terms), "topic")
    # As many terms as were asked for, so they fit a pattern.
    names = [row.word for row in topic.orderBy("rank").collect()]
    posts = materialize(enrich.filter_topic(shares, names).select(
        "uid", "ouid", "sentiment", tx.scrub_links("body").alias("tweets")), "tweets")
    edges = materialize(graph.drop_self_loops(graph.share_edges(posts)), "edges")
    core = materialize(graph.above_core(edges, graph.core_numbers(edges)), "core")
    labels, coords = at_once(
        shares.sparkSession, lambda: materialize(graph.communities(core, resolution), "labels"),
        lambda: layout(core, 2, layout_rounds))
    points, _ = graph.community_graph(core, labels, coords, coverage=coverage)
    members = materialize(points, "members")
    spoken = graph.join_unique(posts, members.select(F.col("label").alias("uid"), "community"),
                               "uid")
    mood = graph.community_sentiment(spoken, normalize=True)
    texts = (spoken.select("community", "tweets").distinct()
             .select("community", tx.cloud_tokens("tweets", stop_words).alias(TOKENS)))
    return TopicStory(topic, members, mood, graph.community_wordcloud(texts, top))
