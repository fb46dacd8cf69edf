"""Sources, sinks, filters, scalar functions and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.catalog.registry import query
from murmura.functions import text as tx
from murmura.functions.tweet_tokens import tweet_tokens
from murmura.operators import counters, enrich, sentiment
from murmura.runtime import scratch_path
from murmura.schema import ACTIVITY, DATE, TOKENS
from murmura.sources import activities as files
from murmura.sources import tables

SORTED = "md5(array_to_string(list_sort({x}), ' '))"


def _digest(tokens: str = TOKENS):
    return F.md5(F.array_join(F.sort_array(tokens), " "))


@query(f"""WITH {fx.SENTIMENT}
SELECT post_id, postedDate, verb, uid, CAST(len(toks) AS INTEGER) AS n_toks,
       {SORTED.format(x='toks')} AS toks_md5, sentiment FROM scored""")
def posts_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English posts with date, clean token set and sentiment."""
    return fx.posts(spark, sf_dir).select(
        "post_id", DATE, "verb", F.col("actor.preferredUsername").alias("uid"),
        F.size(TOKENS).alias("n_toks"), _digest().alias("toks_md5"), "sentiment")


@query()
def posts_enriched_full_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the full tweet tokenizer and Spark's own stop words."""
    posts = enrich.enrich_posts(fx.activities(spark, sf_dir), fx.lexicon(spark))
    return posts.select("post_id", DATE, F.size(TOKENS).alias("n_toks"),
                        _digest().alias("toks_md5"), "sentiment")


@query()
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full tokenizer over raw HTML, entities decoded, every page whole."""
    found = tweet_tokens("html")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("md5"))


@query(f"""WITH {fx.TOKS}
SELECT post_id, verb, postedDate, uid AS AU, CAST(len(toks) AS INTEGER) AS n_toks FROM toks""")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table after the body exclusion."""
    return fx.toks(spark, sf_dir).select("post_id", "verb", DATE, "AU",
                                         F.size(TOKENS).alias("n_toks"))


@query(f"""WITH {fx.SHARES}
SELECT post_id, uid, ouid, {SORTED.format(x='toks')} AS toks_md5, sentiment FROM shares""")
def share_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.shares(spark, sf_dir).select("post_id", "uid", "ouid",
                                           _digest().alias("toks_md5"), "sentiment")


@query(f"""WITH {fx.SHARES} SELECT count(*) AS posts FROM shares
WHERE postedDate >= '2024-01-05' AND postedDate < '2024-01-12'""")
def share_slice_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the share slice of a date range."""
    posts = fx.unscored(spark, sf_dir).withColumn("sentiment", F.lit(0))
    return enrich.share_slice(posts, "2024-01-05", "2024-01-12").agg(
        F.count("*").alias("posts"))


@query(f"""WITH {fx.SHARES} SELECT post_id, uid, ouid FROM shares
WHERE len(list_intersect(toks, ['#click', '#t7', '@u12'])) > 0""")
def shares_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares holding one of the search terms as a whole token."""
    return enrich.filter_terms(fx.shares(spark, sf_dir), " #Click,#t7,@u12").select(
        "post_id", "uid", "ouid")


@query(f"""WITH {fx.POSTS} SELECT post_id, verb FROM posts
WHERE regexp_matches(body, '(?i) (#t1|#t22|the) ')""")
def posts_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a topic word between blanks, in any case."""
    posts = enrich.with_post_id(fx.activities(spark, sf_dir))
    return enrich.filter_topic(posts, ["#t1", "#t22", "the"]).select("post_id", "verb")


@query(f"WITH {fx.POSTS} SELECT postedHour, count(*) AS count FROM posts GROUP BY ALL")
def posts_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.posts_per_hour(fx.activities(spark, sf_dir))


@query(f"""WITH {fx.TOKS}
SELECT CASE WHEN starts_with(term, '#') THEN '#' WHEN starts_with(term, '@') THEN '@'
       ELSE 'S' END AS kind, count(*) AS uses, count(DISTINCT term) AS terms
FROM terms GROUP BY ALL""")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and different terms per kind, from the counted terms."""
    counts = counters.token_totals(fx.toks(spark, sf_dir))
    return counts.groupBy(tx.entity_kind("term").alias("kind")).agg(
        F.sum("count").alias("uses"), F.count("*").alias("terms"))


@query(f"""WITH {fx.TOKS}
SELECT post_id, array_to_string(list_sort(list_filter(toks, lambda x: x[1] IN ('#', '@'))), ' ') AS tags
FROM toks""")
def tags_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags and handles of every post."""
    return fx.toks(spark, sf_dir).select(
        "post_id", F.array_join(F.array_sort(tx.tags_and_handles(TOKENS)), " ").alias("tags"))


@query(f"""WITH {fx.POSTS}
SELECT post_id, array_to_string(list_sort(list_distinct(list_filter(
  ['#' || event_type, '#t' || k, CASE WHEN shared THEN '#t' || k END,
   CASE WHEN shared THEN '#by_' || lang END, CASE WHEN shared THEN '@' || ouid END,
   CASE WHEN shared THEN '@' || uid END], lambda x: x IS NOT NULL))), ' ') AS entities
FROM (SELECT *, verb = 'share' AS shared FROM posts)""")
def native_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities a record carries itself, own and shared, lower-cased and distinct."""
    posts = enrich.with_post_id(fx.activities(spark, sf_dir))
    entities = tx.token_set(
        tx.tag_texts("twitter_entities.hashtags"),
        tx.tag_texts("object.twitter_entities.hashtags"),
        tx.mention_texts("twitter_entities.user_mentions"),
        tx.mention_texts("object.twitter_entities.user_mentions"))
    return posts.select("post_id", F.array_join(F.array_sort(entities), " ").alias("entities"))


@query(f"""WITH {fx.POSTS}
SELECT DISTINCT event_type || ', #T' || k AS terms,
       md5(array_to_string(list_sort([event_type, '#t' || k]), ',')) AS query_key FROM posts""")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of a term list, the same for any order, case and blanks."""
    tags = F.col("twitter_entities.hashtags")
    terms = F.concat(F.lower(tags[0]["text"]), F.lit(", #"), F.upper(tags[1]["text"]))
    return (fx.activities(spark, sf_dir).select(terms.alias("terms")).distinct()
            .select("terms", tx.query_key(F.col("terms")).alias("query_key")))


@query(r"""SELECT page_id, md5(regexp_replace(html,
  '(https?:\/\/[A-Za-z0-9_\/\.]+)|(&amp;)|(\n)', ' ', 'g')) AS clean_md5 FROM pages""")
def scrubbed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, ampersand entities and line ends replaced by blanks."""
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(tx.scrub_links("html")).alias("clean_md5"))


@query("""SELECT doc_id, lang,
  CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[#@]?[a-z0-9_]+')),
       lambda x: length(x) >= 2 AND NOT starts_with(x, 'http')
       AND NOT regexp_full_match(x, '[0-9]*[:./-]?[0-9]*[:./-]?[0-9]*'))) AS INTEGER) AS n_toks,
  CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[#@]?[a-z0-9_]+')),
       lambda x: length(x) >= 2 AND NOT starts_with(x, 'http')
       AND NOT regexp_full_match(x, '[0-9]*(:|.|/|-)?[0-9]*(:|.|/|-)?[0-9]*'))) AS INTEGER)
  AS n_legacy FROM documents""")
def number_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean token sets with the corrected and the legacy number pattern."""
    words = F.array_distinct(tx.simple_tokens("text"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", "lang",
        F.size(tx.token_set(tx.clean_tokens(words))).alias("n_toks"),
        F.size(tx.token_set(tx.clean_tokens(words, legacy_numbers=True))).alias("n_legacy"))


@query(f"""WITH {fx.SENTIMENT}
SELECT verb, sentiment, count(*) AS posts FROM scored GROUP BY ALL""")
def sentiment_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment with the join form used for large lexicons."""
    scored = sentiment.score_by_join(fx.unscored(spark, sf_dir), fx.lexicon(spark), "post_id")
    return scored.groupBy("verb", "sentiment").agg(F.count("*").alias("posts"))


@query(f"""WITH {fx.SENTIMENT}
SELECT word, count(DISTINCT post_id) AS posts, round(any_value(s), 6) AS score
FROM (SELECT post_id, unnest(toks) AS word FROM en) JOIN lexicon USING (word) GROUP BY word""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts per lexicon word, counted before the lexicon is joined."""
    counts = counters.token_totals(fx.unscored(spark, sf_dir)).withColumnRenamed("term", "word")
    return counts.join(fx.lexicon(spark), "word").select(
        "word", F.col("count").alias("posts"),
        F.round(F.col("positive") - F.col("negative"), 6).alias("score"))


@query(f"""WITH {fx.POSTS}
SELECT postedDate, verb, lang AS twitter_lang, count(*) AS posts,
       CAST(sum(length(body)) AS BIGINT) AS chars FROM posts GROUP BY ALL""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as gzipped JSON and read back with the fixed schema."""
    folder = scratch_path(spark, "json")
    files.write_activities(fx.activities(spark, sf_dir), folder)
    back = files.read_activities(spark, f"{folder}/*.json.gz", ACTIVITY)
    return back.groupBy(tx.post_date("postedTime").alias(DATE), "verb", "twitter_lang").agg(
        F.count("*").alias("posts"), F.sum(F.length("body")).alias("chars"))


@query(f"""WITH {fx.TOKS}
SELECT postedDate, verb, count(*) AS posts, CAST(sum(len(toks)) AS BIGINT) AS tokens FROM toks
WHERE postedDate BETWEEN '2024-01-10' AND '2024-01-12' GROUP BY ALL""")
def partitioned_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date-partitioned token table; an inclusive range reads its folders only."""
    root = scratch_path(spark, "tokens")
    tables.write_tokens(fx.toks(spark, sf_dir), root)
    days = enrich.slice_dates(tables.read_table(spark, root), "2024-01-10", "2024-01-12",
                              inclusive=True)
    return days.groupBy(DATE, "verb").agg(F.count("*").alias("posts"),
                                          F.sum(F.size(TOKENS)).alias("tokens"))


@query(f"""WITH {fx.TOKS}
SELECT postedDate, count(*) AS posts FROM toks WHERE postedDate = '2024-01-20' GROUP BY ALL""")
def partitioned_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of the partitioned token table."""
    root = scratch_path(spark, "tokens")
    tables.write_tokens(fx.toks(spark, sf_dir), root)
    return tables.read_day(spark, root, "2024-01-20").groupBy(DATE).agg(
        F.count("*").alias("posts"))


@query(f"""WITH {fx.TOKS}
SELECT postedHour, count(*) AS uses FROM terms GROUP BY ALL""")
def json_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON output partitioned by hour, read back."""
    folder = scratch_path(spark, "hours")
    posts = enrich.exclude_bodies(fx.unscored(spark, sf_dir), fx.EXCLUDED)
    hours = posts.select(tx.post_hour("postedTime").alias("postedHour"), TOKENS)
    uses = hours.groupBy("postedHour").agg(F.sum(F.size(TOKENS)).alias("uses"))
    tables.write_json(uses, folder, by="postedHour")
    back = spark.read.schema("postedHour string, uses bigint").json(folder)
    return back.select("postedHour", "uses")


@query("""SELECT role, word, count FROM (
  SELECT role, word, count(*) AS count,
         row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, word) AS r
  FROM (SELECT role, unnest(list_filter(regexp_extract_all(
          regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s#@'']+', ' ', 'g'),
            '(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+', '\\1 ', 'g'), '''(s|d|ll|ve|re)', '', 'g'),
          '[#@]?[A-Za-z0-9_'']+'), lambda x: length(x) > 1)) AS w FROM conversations)
  , LATERAL (SELECT CASE WHEN w[1] IN ('#', '@') THEN w ELSE lower(w) END AS word)
  GROUP BY role, word) WHERE r <= 20""")
def cloud_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used word-cloud words per speaker's role."""
    from murmura.operators.ranking import top_n
    turns = fx.table(spark, sf_dir, "conversations").select(
        "role", F.explode(tx.cloud_tokens("text")).alias("word"))
    counts = turns.groupBy("role", "word").agg(F.count("*").alias("count"))
    return top_n(counts, ["role"], 20, ties=["word"]).drop("rank")


@query("""SELECT event_id, CASE WHEN day(ts) > 9 THEN CAST(ts AS DATE) END AS parsed FROM events""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict date parsing: a day written with one digit gives NULL."""
    return fx.table(spark, sf_dir, "events").select(
        "event_id", tx.parse_date(F.date_format("ts", "yyyy-MM-d")).alias("parsed"))
