"""Counters, the counter store, rankings and time series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.catalog.registry import query
from murmura.functions import text as tx
from murmura.operators import counters, enrich, ranking
from murmura.plans.reports import top_terms_json
from murmura.runtime import materialize, scratch_path
from murmura.schema import AUTHOR, DATE, TOKENS
from murmura.sources import counter_store as store

DAY = "2024-01-15"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.entity_counts(fx.toks(spark, sf_dir))


@query(f"WITH {fx.ENTITY_COUNTS} SELECT postedDate, kind, term, count FROM counts")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"""WITH {fx.TOKS}
SELECT postedDate, uid AS author, count(*) AS count FROM toks GROUP BY ALL""")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.author_counts(fx.toks(spark, sf_dir))


@query(f"""WITH {fx.TOKS}
SELECT postedDate, term AS hashtag, count(*) AS count FROM terms
WHERE starts_with(term, '#') GROUP BY ALL""")
def hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.hashtag_counts(fx.toks(spark, sf_dir))


@query(f"""WITH {fx.TOKS}
SELECT postedDate, term AS hashtag, count(DISTINCT uid) AS count FROM terms
WHERE starts_with(term, '#') GROUP BY ALL""")
def hashtag_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.hashtag_reach(fx.toks(spark, sf_dir))


_TAG_AUTHORS = f"""WITH {fx.TOKS},
ta AS (SELECT postedDate, term AS hashtag, uid AS author, count(*) AS count FROM terms
       WHERE starts_with(term, '#') AND verb = 'post' GROUP BY ALL)"""


@query(f"{_TAG_AUTHORS} SELECT * FROM ta")
def hashtag_author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.hashtag_author_counts(fx.toks(spark, sf_dir))


@query(f"""{_TAG_AUTHORS}
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY postedDate, hashtag
    ORDER BY count DESC, author) AS INTEGER) AS rank FROM ta) WHERE rank <= 3""")
def top_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most active authors of each hashtag and day."""
    return ranking.top_authors_for(counters.hashtag_author_counts(fx.toks(spark, sf_dir)), 3)


_PAIRS = """
SELECT {keys} a.t AS tok1, b.t AS tok2, count(*) AS count
FROM ({src}) a JOIN ({src}) b ON a.post = b.post AND a.t < b.t GROUP BY ALL"""

_TURNS = """SELECT DISTINCT conv_id * 1000 + turn AS post, role,
  unnest(list_filter(regexp_extract_all(lower(text), '[#@]?[a-z0-9_]+'), lambda x: length(x) >= 2)) AS t
FROM conversations"""


@query(_PAIRS.format(keys="a.role,", src=_TURNS))
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All word pairs of every conversation turn, per role."""
    return counters.pair_counts(fx.turns(spark, sf_dir), by="role")


@query(_PAIRS.format(keys="", src=_TURNS))
def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the whole table, largest first."""
    pairs = counters.pair_counts(fx.turns(spark, sf_dir), by=None)
    return counters.largest_first(pairs, "tok1", "tok2")


_TAGS = "SELECT post_id AS post, postedDate, postedHour, term AS t FROM terms WHERE term[1] IN {}"


@query(f"WITH {fx.TOKS}" + _PAIRS.format(keys="a.postedDate,", src=_TAGS.format("('#', '@')")))
def tag_pairs_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hashtags and handles per day."""
    return counters.pair_counts(fx.toks(spark, sf_dir), tokens=tx.tags_and_handles(TOKENS))


@query(f"WITH {fx.TOKS}" + _PAIRS.format(keys="a.postedHour,", src=_TAGS.format("('#', '@')")))
def tag_pairs_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hashtags and handles per hour."""
    posts = enrich.exclude_bodies(fx.unscored(spark, sf_dir), fx.EXCLUDED)
    hours = posts.select(tx.post_hour("postedTime").alias("postedHour"), TOKENS)
    return counters.pair_counts(hours, "postedHour", tx.tags_and_handles(TOKENS))


@query(f"WITH {fx.TOKS}" + _PAIRS.format(keys="", src=_TAGS.format("('#')")))
def hashtag_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.hashtag_pair_counts(fx.toks(spark, sf_dir))


@query(f"""WITH {fx.TOKS}, pairs AS ({_PAIRS.format(keys="a.postedDate,",
                                                    src=_TAGS.format("('#', '@')"))}),
two_way AS (SELECT postedDate, tok1, tok2, count FROM pairs
         UNION ALL SELECT postedDate, tok2, tok1, count FROM pairs)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY postedDate, tok1
    ORDER BY count DESC, tok2) AS INTEGER) AS rank FROM two_way) WHERE rank <= 3""")
def top_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent partners of each tag and day, from either direction."""
    pairs = counters.pair_counts(fx.toks(spark, sf_dir), tokens=tx.tags_and_handles(TOKENS))
    return ranking.top_partners_for(counters.both_directions(pairs), 3)


@query(f"""WITH {fx.POSTS},
ent AS (SELECT DISTINCT post_id AS post, unnest(list_filter(
  ['#' || event_type, '#t' || k, CASE WHEN verb = 'share' THEN '#by_' || lang END,
   CASE WHEN verb = 'share' THEN '@' || ouid END,
   CASE WHEN verb = 'share' THEN '@' || uid END], lambda x: x IS NOT NULL)) AS t FROM posts)
""" + _PAIRS.format(keys="", src="SELECT * FROM ent"))
def entity_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the records' own entities, shared posts included."""
    return counters.entity_pair_counts(fx.activities(spark, sf_dir))


@query(f"WITH {fx.TOKS} SELECT term, count(*) AS count FROM terms GROUP BY ALL")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.largest_first(counters.token_totals(fx.toks(spark, sf_dir)), "term")


@query(f"""WITH {fx.TOKS} SELECT term AS word, count(*) AS freq FROM terms
GROUP BY ALL HAVING count(*) >= 10""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.word_frequency(fx.toks(spark, sf_dir), 10)


@query(f"""WITH {fx.ENTITY_COUNTS}
SELECT * EXCLUDE (count), count AS score FROM (
  SELECT postedDate, kind, term, count, CAST(row_number() OVER (
      PARTITION BY postedDate, kind ORDER BY count DESC, term) AS INTEGER) AS rank
  FROM counts WHERE kind IN ('#', '@')) WHERE rank <= 10""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used hashtags and handles of every day."""
    return ranking.top_terms(_counts(spark, sf_dir), 10)


@query(f"""WITH {fx.ENTITY_COUNTS}
SELECT '{DAY}' AS postedDate, '#click' AS term, coalesce(max(count), 0) AS count
FROM counts WHERE postedDate = '{DAY}' AND term = '#click'
UNION ALL
SELECT '{DAY}', '#never', coalesce(max(count), 0)
FROM counts WHERE postedDate = '{DAY}' AND term = '#never'""")
def term_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of a term on a day, 0 for one never used."""
    counts = _counts(spark, sf_dir)
    return ranking.term_count(counts, DAY, "#Click").unionByName(
        ranking.term_count(counts, DAY, "#never"))


@query(f"""WITH {fx.ENTITY_COUNTS},
words AS (SELECT DISTINCT term AS word FROM terms)
SELECT word, coalesce(c.count, 0) AS count FROM words
LEFT JOIN (SELECT * FROM counts WHERE postedDate = '{DAY}') c ON c.term = word""")
def counts_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the month with its count on one day, 0 if unused that day."""
    toks = fx.toks(spark, sf_dir)
    words = counters.token_totals(toks).select(F.col("term").alias("word"))
    return ranking.term_counts(words, counters.entity_counts(toks), DAY)


@query(f"WITH {fx.ENTITY_COUNTS} SELECT postedDate, kind, term, count FROM counts")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one of them written twice, folded in between: counted once."""
    path = scratch_path(spark, "counts")
    toks = fx.toks(spark, sf_dir)
    when = datetime(2024, 2, 1)
    for batch, verb in ((0, "post"), (1, "share"), (1, "share")):
        part = counters.entity_counts(toks.filter(F.col("verb") == verb))
        store.merge_counts(path, part, batch, when)
        if batch == 0:
            store.fold_counts(spark, path, 0)
    return store.read_counts(spark, path).drop("updated_at")


@query(f"""WITH {fx.ENTITY_COUNTS}
SELECT postedDate, kind, term, count FROM counts WHERE postedDate >= '{DAY}'""")
def expired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days last updated more than a week ago are gone."""
    path = scratch_path(spark, "counts")
    # Counted once: a batch for each half would tokenize its posts, and the other's, again.
    counts = materialize(_counts(spark, sf_dir), "counts")
    store.merge_counts(path, counts.filter(F.col(DATE) < DAY), 0, datetime(2024, 1, 15))
    store.merge_counts(path, counts.filter(F.col(DATE) >= DAY), 1, datetime(2024, 1, 31))
    alive = store.expire_counts(store.read_counts(spark, path), datetime(2024, 2, 1))
    return alive.drop("updated_at")


@query(f"""WITH {fx.ENTITY_COUNTS}
SELECT postedDate, kind, term, count, CAST(1 AS BIGINT) AS folders FROM counts
WHERE postedDate >= '{DAY}'""")
def expired_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in ten batches; old days are removed with the folders, a repeated batch adds nothing."""
    path = scratch_path(spark, "counts")
    counts = materialize(_counts(spark, sf_dir), "counts")
    for batch in range(10):
        own = counts.filter(F.pmod(F.xxhash64("term"), F.lit(10)) == batch)
        for part, late in ((own.filter(F.col(DATE) < DAY), 0), (own.filter(F.col(DATE) >= DAY), 1)):
            store.merge_counts(path, part, 2 * batch + late, datetime(2024, 1, 15 + 16 * late))
    store.expire_store(spark, path, datetime(2024, 2, 1))
    store.merge_counts(path, counts.filter(F.col(DATE) >= DAY), 3, datetime(2024, 1, 31))
    dates = store.read_counts(spark, path).drop("updated_at")
    folders = spark.read.parquet(f"{path}/folded").select("folded_to").distinct()
    return dates.withColumn("folders", folders.agg(F.count("*")).scalar())


_SERIES = f"""WITH {fx.TOKS},
points AS (SELECT '#' AS series, term, postedDate, count(*) AS count FROM terms
           WHERE starts_with(term, '#') GROUP BY ALL
           UNION ALL
           SELECT '#@', term, postedDate, count(DISTINCT uid) FROM terms
           WHERE starts_with(term, '#') GROUP BY ALL)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Posts are tokenized once; their hashtags, which are all that is counted here, are kept.
    toks = materialize(fx.toks(spark, sf_dir).select(DATE, AUTHOR, tx.hashtags(TOKENS).alias(TOKENS)),
                       "toks")
    uses = counters.hashtag_counts(toks).withColumnRenamed("hashtag", "term")
    reach = counters.hashtag_reach(toks).withColumnRenamed("hashtag", "term")
    # An earlier write of the same points, with other values, is overwritten.
    stale = uses.withColumn("count", F.lit(-1).cast("bigint")).withColumn("batch_id", F.lit(0))
    written = stale.unionByName(uses.withColumn("batch_id", F.lit(1)))
    return counters.term_series("#", written).unionByName(
        counters.term_series("#@", reach.withColumn("batch_id", F.lit(1))))


@query(f"{_SERIES} SELECT * FROM points")
def term_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and reach of each hashtag per day; the last write wins."""
    return _series(spark, sf_dir)


@query(f"""{_SERIES}
SELECT series, term, to_json(map(list(postedDate ORDER BY postedDate),
                                 list(count ORDER BY postedDate))) AS points
FROM points GROUP BY series, term""")
def term_series_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date-to-count map per series and term, as JSON."""
    return counters.series_map(_series(spark, sf_dir)).withColumn("points", F.to_json("points"))


@query(f"""WITH {fx.ENTITY_COUNTS}, ranked AS (
  SELECT postedDate, kind, term, count AS score, row_number() OVER (
      PARTITION BY postedDate, kind ORDER BY count DESC, term) AS rank
  FROM counts WHERE kind IN ('#', '@'))
SELECT postedDate, to_json({{'success': true, 'status': 0,
  'hashtags': coalesce(list({{'term': term, 'score': score}} ORDER BY rank)
      FILTER (kind = '#'), []),
  'handles': coalesce(list({{'term': term, 'score': score}} ORDER BY rank)
      FILTER (kind = '@'), [])}}) AS response
FROM ranked WHERE rank <= 5 GROUP BY postedDate""")
def top_terms_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer of the top-terms report, one per day."""
    return top_terms_json(ranking.top_terms(_counts(spark, sf_dir), 5))
