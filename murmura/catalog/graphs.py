"""The sharing graph, its communities and what they talk about."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.catalog.registry import query
from murmura.operators import enrich, graph
from murmura.operators.layout import layout, layout_file, layout_fixed
from murmura.plans import reports
from murmura.runtime import materialize, scratch_path
from murmura.schema import DATE, TOKENS
from murmura.sources import registry, tables

TERM = "#click"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.unscored(spark, sf_dir).withColumn("sentiment", F.lit(0))
    return graph.share_edges(enrich.share_slice(posts))


def _kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_edges(spark, sf_dir), "edges")


def _planted(edges: DataFrame) -> DataFrame:
    group = F.substring("id", 2, 20).cast("bigint") % 5
    return graph.nodes(edges).select("id", group.alias("community"))


@query(f"WITH {fx.EDGES} SELECT src, dst, w FROM edges")
def share_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH {fx.EDGES} SELECT src, dst, w FROM edges")
def edge_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as CSV and read back."""
    path = scratch_path(spark, "edges")
    tables.write_edges(_edges(spark, sf_dir), path)
    return tables.read_edges(spark, path)


_NODES = "SELECT src AS id FROM edges UNION SELECT dst FROM edges"


@query(f"""WITH {fx.EDGES}
SELECT id, id AS label, row_number() OVER (ORDER BY id) - 1 AS store_id FROM ({_NODES})""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes implied by the edges with their stable number."""
    return graph.build_graph(_kept_edges(spark, sf_dir))[0]


@query(f"""WITH {fx.EDGES}
SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges WHERE src <> dst
       UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY id""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degree plus out-degree without self-loops."""
    return graph.degrees(graph.drop_self_loops(_edges(spark, sf_dir)))


def _core_sql(k: int) -> str:
    ends = "SELECT src AS id FROM core UNION ALL SELECT dst FROM core"
    strong = f"SELECT id FROM ({ends}) GROUP BY id HAVING count(*) >= {k}"
    weak = f"SELECT id FROM ({ends}) GROUP BY id HAVING count(*) < {k}"
    return f"""WITH RECURSIVE {fx.EDGES},
core(turn, src, dst, w) AS (
  SELECT 0, src, dst, w FROM edges WHERE src <> dst
  UNION ALL
  SELECT turn + 1, src, dst, w FROM core
  WHERE src IN ({strong}) AND dst IN ({strong}) AND EXISTS ({weak}))
SELECT src, dst, w FROM core WHERE turn = (SELECT max(turn) FROM core)
  AND {k} <= ALL (SELECT count(*) FROM (SELECT turn, src AS id FROM core
                  UNION ALL SELECT turn, dst FROM core)
                  WHERE turn = (SELECT max(turn) FROM core) GROUP BY id)"""


@query(_core_sql(2))
def two_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_core(_edges(spark, sf_dir), 2)


@query(_core_sql(9))
def nine_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A higher core, which takes several rounds of peeling."""
    return graph.k_core(_edges(spark, sf_dir), 9)


_CORE_NUMBERS = f"""WITH RECURSIVE {fx.EDGES},
pairs AS (SELECT src AS id, dst AS nb FROM edges WHERE src <> dst
          UNION SELECT dst, src FROM edges WHERE src <> dst),
est(turn, id, core) AS (
  SELECT 0, id, count(*) FROM pairs GROUP BY id
  UNION ALL
  SELECT turn + 1, id, least(any_value(mine), max(least(v, r))) FROM (
    SELECT e.turn, p.id, m.core AS mine, e.core AS v,
           row_number() OVER (PARTITION BY p.id ORDER BY e.core DESC) AS r
    FROM pairs p JOIN est e ON e.id = p.nb JOIN est m ON m.id = p.id)
  WHERE turn < 60 GROUP BY turn, id)"""


@query(f"{_CORE_NUMBERS} SELECT id, core FROM est WHERE turn = 60")
def core_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.core_numbers(_edges(spark, sf_dir))


@query(f"""{_CORE_NUMBERS}, kept AS (SELECT id FROM est WHERE turn = 60 AND core > 8)
SELECT src, dst, w FROM edges
WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def inner_core_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-graph of the nodes with a core number above 8."""
    edges = _kept_edges(spark, sf_dir)
    return graph.above_core(edges, graph.core_numbers(edges), 8)


_Q = """
links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w) AS w
          FROM edges GROUP BY ALL),
marked AS (SELECT w, x.community AS ca, y.community AS cb
           FROM links JOIN labels x ON x.id = a JOIN labels y ON y.id = b),
per AS (SELECT c, sum(w) AS degree, sum(inside) AS inside FROM (
  SELECT ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS inside FROM marked
  UNION ALL SELECT cb, w, 0 FROM marked) GROUP BY c)"""


@query(f"""WITH {fx.PLANTED}, {_Q}
SELECT round(2 * sum(inside) / sum(degree)
             - 1.0 * sum(degree * degree) / (sum(degree) * sum(degree)), 6) AS modularity
FROM per""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the known groups."""
    edges = _kept_edges(spark, sf_dir)
    return graph.modularity(edges, _planted(edges)).select(
        F.round("modularity", 6).alias("modularity"))


@query(f"WITH {fx.PLANTED} SELECT community, count(*) AS size FROM labels GROUP BY community")
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_sizes(_planted(_edges(spark, sf_dir)))


_SIZES = f"""WITH {fx.PLANTED},
sizes AS (SELECT community, count(*) AS size FROM labels GROUP BY community)"""


@query(f"{_SIZES} SELECT community, size FROM sizes ORDER BY size DESC, community LIMIT 3")
def top_communities_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_communities(_planted(_edges(spark, sf_dir)), k=3)


_TAKEN = """taken AS (SELECT community, size FROM (
  SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, community
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER () AS total FROM sizes) WHERE before < 0.7 * total)"""


@query(f"{_SIZES}, {_TAKEN} SELECT community, size FROM taken")
def top_communities_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_communities(_planted(_kept_edges(spark, sf_dir)), coverage=0.7)


@query(f"""{_SIZES}, {_TAKEN},
ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM labels)
SELECT labels.id AS label, num.n AS id, degree, community,
       CASE WHEN labels.id IN (SELECT src FROM edges)
            THEN CAST(substr(labels.id, 2) AS DOUBLE) END AS x,
       CASE WHEN labels.id IN (SELECT src FROM edges) THEN 1.0::DOUBLE END AS y,
       CASE WHEN labels.id IN (SELECT src FROM edges) THEN 0.0::DOUBLE END AS z
FROM labels JOIN deg USING (id) JOIN num USING (id)
WHERE community IN (SELECT community FROM taken)""")
def community_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept nodes left-joined to coordinates, which only sharers have here."""
    edges = _kept_edges(spark, sf_dir)
    coords = edges.select(F.col("src").alias("id")).distinct().select(
        "id", F.substring("id", 2, 20).cast("double").alias("x"), F.lit(1.0).alias("y"),
        F.lit(0.0).alias("z"))
    return graph.community_graph(edges, _planted(edges), coords, coverage=0.7)[0]


@query(f"""{_SIZES}, {_TAKEN},
kept AS (SELECT id FROM labels WHERE community IN (SELECT community FROM taken))
SELECT src AS source, dst AS target, w AS weight FROM edges
WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def community_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends in kept communities."""
    edges = _kept_edges(spark, sf_dir)
    return graph.community_graph(edges, _planted(edges), coverage=0.7)[1]


@query(f"""WITH {fx.PLANTED},
two AS (SELECT community, count(*) AS size, min(id) AS first FROM labels GROUP BY community),
names AS (SELECT community, row_number() OVER (ORDER BY size DESC, first) - 1 AS name FROM two)
SELECT id, name AS community FROM labels JOIN names USING (community)""")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities found in the graph; they are the five known groups."""
    return graph.communities(_edges(spark, sf_dir))


@query()
def communities_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger resolution, which gives smaller communities."""
    return graph.communities(_edges(spark, sf_dir), resolution=2.0)


# --- details of the known groups ---------------------------------------------------

def _members(shares: DataFrame) -> DataFrame:
    return _planted(graph.share_edges(shares)).withColumnRenamed("id", "uid")


_TALK = fx.PLANTED + """,
talk AS (SELECT shares.*, community FROM shares JOIN labels ON labels.id = uid)"""
_CLICK_TALK = _TALK.replace(fx.PLANTED, fx.CLICK_PLANTED)


def _talk(spark: SparkSession, sf_dir: str, side: str = "uid") -> DataFrame:
    shares = materialize(fx.shares(spark, sf_dir), "shares")
    return graph.community_posts(shares, _members(shares), side)


@query(f"WITH {_TALK} SELECT post_id, uid, ouid, community FROM talk")
def community_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("post_id", "uid", "ouid", "community")


@query(f"""WITH {fx.PLANTED} SELECT DISTINCT post_id, community
FROM shares JOIN labels ON labels.id = uid OR labels.id = ouid""")
def community_posts_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of a community by sharer or by author."""
    return _talk(spark, sf_dir, "either").select("post_id", "community")


@query(f"""WITH {_TALK} SELECT community, count(*) FILTER (sentiment = 1) AS positive,
count(*) FILTER (sentiment = -1) AS negative, count(*) FILTER (sentiment = 0) AS neutral
FROM talk GROUP BY community""")
def community_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_sentiment(_talk(spark, sf_dir))


@query(f"""WITH {_TALK} SELECT community,
round(count(*) FILTER (sentiment = 1) / count(*), 6) AS positive,
round(count(*) FILTER (sentiment = -1) / count(*), 6) AS negative,
round(count(*) FILTER (sentiment = 0) / count(*), 6) AS neutral
FROM talk GROUP BY community""")
def community_sentiment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = graph.community_sentiment(_talk(spark, sf_dir), normalize=True)
    return mood.select("community", *[F.round(c, 6).alias(c)
                                      for c in ("positive", "negative", "neutral")])


@query(f"""WITH {_TALK}, words AS (
  SELECT community, word, count(*) AS count
  FROM (SELECT community, unnest(toks) AS word FROM talk)
  WHERE NOT starts_with(word, '@') GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY community
    ORDER BY count DESC, word) AS INTEGER) AS rank FROM words) WHERE rank <= 20""")
def community_wordcloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_wordcloud(_talk(spark, sf_dir), 20)


@query(f"""WITH {_TALK}
SELECT community, count(DISTINCT md5(text)) AS texts FROM talk GROUP BY community""")
def distinct_share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts shared per community."""
    return (_talk(spark, sf_dir).select("community", F.md5("body").alias("text")).distinct()
            .groupBy("community").agg(F.count("*").alias("texts")))


@query(f"""WITH {_CLICK_TALK}, words AS (
  SELECT community, word, count(*) AS count
  FROM (SELECT community, unnest(toks) AS word FROM talk)
  WHERE NOT starts_with(word, '@') GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY community
             ORDER BY count DESC, word) AS rank FROM words),
cloud AS (SELECT community, list({{'word': word, 'count': count}} ORDER BY rank) AS wordcloud
          FROM ranked WHERE rank <= 5 GROUP BY community),
mood AS (SELECT community, [count(*) FILTER (sentiment = 1), count(*) FILTER (sentiment = -1),
           count(*) FILTER (sentiment = 0)] AS sentiment FROM talk GROUP BY community)
SELECT community, to_json({{'sentiment': sentiment, 'wordcloud': wordcloud}}) AS response
FROM mood JOIN cloud USING (community)""")
def community_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details report for the known groups, one JSON answer per community."""
    shares = materialize(fx.shares(spark, sf_dir), "shares")
    members = _members(enrich.filter_terms(shares, TERM))
    return reports.community_details_json(
        *reports.community_details(shares, TERM, members, 5))


@query("""WITH w AS (SELECT role, unnest(list_filter(list_distinct(regexp_extract_all(
  lower(text), '[#@]?[a-z0-9_]+')), lambda x: length(x) >= 2)) AS word FROM conversations),
c AS (SELECT role, word, count(*) AS count FROM w WHERE NOT starts_with(word, '@') GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY role ORDER BY count DESC, word)
               AS INTEGER) AS rank FROM c) WHERE rank <= 25""")
def words_per_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used words per speaker's role in conversations."""
    return graph.community_wordcloud(fx.turns(spark, sf_dir), 25, group="role", tokens=TOKENS)


@query(f"WITH {fx.PLANTED} SELECT id AS uid, community FROM labels")
def cached_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members stored twice under one query key and read before they expire."""
    root, now = scratch_path(spark, "members"), datetime(2024, 1, 1)
    labels = _planted(_kept_edges(spark, sf_dir))
    key = reports.key_of(spark, TERM)
    for _ in range(2):
        registry.save_membership(root, key, labels, now)
    return registry.read_membership(spark, root, key, now + timedelta(seconds=599))


@query(f"""WITH {fx.SHARES}
SELECT post_id, uid, ouid, sentiment, CAST(len(toks) AS INTEGER) AS n_toks FROM shares
WHERE postedDate >= '2024-01-05' AND postedDate < '2024-01-12'""")
def loaded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written by date; the share slice of a week is read from its folders."""
    root = scratch_path(spark, "posts")
    # Records are placed by date before they have tokens, so these are not shuffled.
    records = enrich.english(fx.activities(spark, sf_dir)).withColumn(DATE, enrich.tx.post_date("postedTime"))
    posts = enrich.enrich_posts(records.hint("rebalance", F.col(DATE)), fx.lexicon(spark), **fx.PLAIN)
    tables.write_posts(posts, root, rebalance=False)
    week = reports.load_slice(spark, root, "2024-01-05", "2024-01-12")
    return week.select("post_id", "uid", "ouid", "sentiment", F.size(TOKENS).alias("n_toks"))


# --- layout and whole reports -------------------------------------------------------

@query()
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(_edges(spark, sf_dir), 2)


@query(f"""WITH {fx.PLANTED}
SELECT count(*) AS nodes, count(*) AS finite, count(*) AS flat, true AS members_nearer
FROM labels""")
def layout_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node is placed once in the plane, and linked groups lie together."""
    edges = _kept_edges(spark, sf_dir)
    placed = layout(edges, 2)
    finite = ~(F.isnan("x") | F.isnan("y")) & (F.abs("x") + F.abs("y") < 1e12)
    group = placed.join(_planted(edges), "id")
    ends = [group.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}")
                                                 for c in ("x", "y", "community")])
            for e in ("src", "dst")]
    gap = F.hypot(F.col("x_src") - F.col("x_dst"), F.col("y_src") - F.col("y_dst"))
    same = F.col("community_src") == F.col("community_dst")
    lines = (graph.drop_self_loops(edges).join(ends[0], "src").join(ends[1], "dst")
             .agg(F.coalesce(F.avg(F.when(same, gap)) < F.avg(F.when(~same, gap)), F.lit(True))
                  .alias("members_nearer")))
    counts = placed.agg(F.count_distinct("id").alias("nodes"), F.count_if(finite).alias("finite"),
                        F.count_if(F.col("z") == 0).alias("flat"))
    return counts.withColumn("members_nearer", lines.scalar())


@query(f"""WITH {fx.EDGES}
SELECT true AS above_planted, CAST(0 AS BIGINT) AS parted,
       (SELECT count(*) FROM ({_NODES})) AS nodes""")
def communities_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine communities: each hangs together, and their modularity beats the known groups'."""
    edges = _kept_edges(spark, sf_dir)
    labels = materialize(graph.communities(edges, resolution=2.0), "labels")
    parts = graph.connected_parts(graph.undirected(edges), labels)
    parted = (labels.select("id", F.col("community").alias("c")).join(parts, "id")
              .groupBy("c").agg(F.count_distinct("community").alias("n")).filter("n > 1"))
    mine, known = (graph.modularity(edges, x, 2.0) for x in (labels, _planted(edges)))
    return labels.agg(F.count_distinct("id").alias("nodes")).select(
        (mine.scalar() >= known.scalar()).alias("above_planted"),
        parted.agg(F.count("*")).scalar().alias("parted"), "nodes")


@query()
def graph_layout_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_fixed(_edges(spark, sf_dir), 3)


@query()
def edge_file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "edges")
    tables.write_edges(_edges(spark, sf_dir), path)
    return layout_file(spark, path)


@query()
def community_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the communities report as JSON lines."""
    shares = enrich.share_slice(fx.unscored(spark, sf_dir).withColumn("sentiment", F.lit(0)))
    found = reports.communities(shares, TERM)
    return reports.community_nodes_json(found.nodes)


@query()
def community_report_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the communities report as JSON lines, without a layout."""
    shares = enrich.share_slice(fx.unscored(spark, sf_dir).withColumn("sentiment", F.lit(0)))
    found = reports.communities(shares, TERM, k=3, with_layout=False)
    return reports.community_edges_json(found.nodes, found.edges)
