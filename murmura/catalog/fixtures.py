"""Activity records derived from the test tables, for Spark and for DuckDB.

Each event is one post: its author is the event's user, its text the tags of the
event followed by a whole document. Clicks and views are shares of another user's
post. Users fall into five groups by ``user_id % 5``; nine of ten shares stay in
the group, so the sharing graph has five known communities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.text import simple_tokens
from murmura.operators import enrich
from murmura.operators.sentiment import lexicon_from_lines
from murmura.schema import TOKENS

# Stop words, exclusions and lexicon of the derived posts.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "for", "as", "with", "that", "at", "by"]
EXCLUDED = ["#error", "#t13"]
LEXICON_LINES = [
    "# made-up senses for the made-up language of the documents",
    "a\t1\t0.5\t0\tattion#1",
    "a\t2\t0.375\t0.125\teriner#1",
    "v\t3\t0.25\t0\ttion#1",
    "a\t4\t0\t0.5\tthanedble#1",
    "r\t5\t0\t0.375\tther#1",
    "v\t6\t0.125\t0.25\tthnt#1",
    "a\t7\t0.75\t0\tanea#1",
    "v\t8\t0\t0.5\tAnea#2",
    "n\t9\t0.75\t0\tthanea#1",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_from_lines(spark.createDataFrame([(x,) for x in LEXICON_LINES], "value string"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested activity records, one per event."""
    events = table(spark, sf_dir, "events")
    documents = table(spark, sf_dir, "documents")
    per_group = events.agg(F.floor(F.max("user_id") / 5) + 1).scalar()
    document_count = documents.agg(F.count("*")).scalar()
    k = F.get_json_object("props", "$.k").cast("bigint")
    keyed = events.select(
        "event_id", "ts", "user_id", "event_type", k.alias("k"),
        per_group.alias("g"), (F.col("event_id") % document_count).alias("doc_id"))
    near = (F.col("user_id") + 5 * ((F.col("event_id") * 7919 + F.col("k")) % F.col("g"))) % (
        5 * F.col("g"))
    far = (F.col("event_id") * 104729 + F.col("user_id")) % (5 * F.col("g"))
    other = F.when(F.col("event_id") % 10 == 0, far).otherwise(near)
    is_share = F.col("event_type").isin("click", "view")
    # Both sides grow with the data: place them alike once, for all tasks, and merge.
    tasks = spark.sparkContext.defaultParallelism
    texts = documents.select("doc_id", "text", "lang").repartition(tasks, "doc_id")
    joined = keyed.repartition(tasks, "doc_id").join(texts.hint("merge"), "doc_id").select(
        F.col("event_id").cast("string").alias("id"),
        F.when(is_share, "share").otherwise("post").alias("verb"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000'Z'").alias("postedTime"),
        "event_type", "k", "text", "lang",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.when(is_share, F.concat(F.lit("u"), other.cast("string"))).alias("ouid"))

    def person(name: Column) -> Column:
        return F.struct(name.alias("preferredUsername"))

    def tag(text: Column) -> Column:
        return F.struct(text.alias("text"))

    def mention(name: Column) -> Column:
        return F.struct(name.alias("screen_name"))

    topic = F.concat(F.lit("t"), F.col("k").cast("string"))
    shared = F.col("ouid").isNotNull()
    no_mentions = F.array().cast("array<struct<screen_name:string>>")
    own_entities = F.struct(
        F.array(tag(F.initcap("event_type")), tag(topic)).alias("hashtags"),
        F.when(shared, F.array(mention(F.upper("ouid")))).otherwise(no_mentions)
        .alias("user_mentions"))
    shared_entities = F.struct(
        F.array(tag(F.upper(topic)), tag(F.concat(F.lit("by_"), F.col("lang"))))
        .alias("hashtags"),
        F.array(mention(F.col("uid"))).alias("user_mentions"))
    body = F.concat(F.lit("#"), F.col("event_type"), F.lit(" #"), topic,
                    F.when(shared, F.concat(F.lit(" @"), F.col("ouid"))).otherwise(""),
                    F.lit(" "), F.col("text"))
    return joined.select(
        "id", "verb", "postedTime", body.alias("body"), F.col("lang").alias("twitter_lang"),
        person(F.col("uid")).alias("actor"),
        F.when(shared, F.struct(F.col("text").alias("body"), person(F.col("ouid")).alias("actor"),
                                shared_entities.alias("twitter_entities"))).alias("object"),
        own_entities.alias("twitter_entities"))


PLAIN = {"stop_words": STOP_WORDS, "tokenizer": simple_tokens}
"""Settings that DuckDB can repeat: its pattern language has no look-around."""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English posts with date, tokens and sentiment."""
    return enrich.enrich_posts(activities(spark, sf_dir), lexicon(spark), **PLAIN)


def unscored(spark: SparkSession, sf_dir: str, tags_only: bool = False) -> DataFrame:
    """English posts with date and tokens only."""
    return enrich.with_tokens(enrich.english(enrich.with_post_id(activities(spark, sf_dir))),
                              tags_only=tags_only, **PLAIN)


def toks(spark: SparkSession, sf_dir: str, tags_only: bool = False) -> DataFrame:
    """Token table without the excluded bodies."""
    return enrich.token_table(enrich.exclude_bodies(unscored(spark, sf_dir, tags_only), EXCLUDED))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.share_slice(posts(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a token table grouped by speaker's role."""
    return table(spark, sf_dir, "conversations").select(
        "role", "conv_id", "turn",
        F.filter(F.array_distinct(simple_tokens("text")), lambda t: F.length(t) >= 2)
        .alias(TOKENS))


# --- the same in DuckDB --------------------------------------------------------

def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


POSTS = """
u AS (SELECT CAST(floor(max(user_id) / 5.0) AS BIGINT) + 1 AS g FROM events),
n AS (SELECT count(*) AS nd FROM documents),
e AS (SELECT event_id, ts, user_id, event_type,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             (SELECT g FROM u) AS g, event_id % (SELECT nd FROM n) AS doc_id,
             event_type IN ('click', 'view') AS shared
      FROM events),
f AS (SELECT e.*, 'u' || user_id AS uid,
             CASE WHEN shared THEN 'u' || CASE WHEN event_id % 10 = 0
                  THEN (event_id * 104729 + user_id) % (5 * g)
                  ELSE (user_id + 5 * ((event_id * 7919 + k) % g)) % (5 * g) END END AS ouid
      FROM e),
posts AS (SELECT CAST(event_id AS VARCHAR) AS post_id,
                 strftime(ts, '%Y-%m-%d') AS postedDate, strftime(ts, '%Y-%m-%dT%H') AS postedHour,
                 CASE WHEN shared THEN 'share' ELSE 'post' END AS verb, uid, ouid,
                 event_type, k, d.lang, d.text,
                 '#' || event_type || ' #t' || k || CASE WHEN shared THEN ' @' || ouid ELSE '' END
                 || ' ' || d.text AS body
          FROM f JOIN documents d ON d.doc_id = f.doc_id)"""

WORDS = "regexp_extract_all(lower({text}), '[#@]?[a-z0-9_]+')"

EN = POSTS + f""",
en AS (SELECT *, list_filter(list_distinct({WORDS.format(text='body')}),
                lambda x: length(x) >= 2 AND NOT starts_with(x, 'http')
                     AND NOT regexp_full_match(x, '[0-9]*[:./-]?[0-9]*[:./-]?[0-9]*')
                     AND x NOT IN ({_quoted(STOP_WORDS)})) AS toks
       FROM posts WHERE lang = 'en')"""

TOKS = EN + """,
toks AS (SELECT * FROM en WHERE NOT regexp_matches(body, '#error|#t13')),
terms AS (SELECT post_id, postedDate, postedHour, verb, uid, unnest(toks) AS term FROM toks)"""

SENTIMENT = EN + """,
senses(word, p, n) AS (VALUES ('attion', 0.5, 0.0), ('eriner', 0.375, 0.125), ('tion', 0.25, 0.0),
    ('thanedble', 0.0, 0.5), ('ther', 0.0, 0.375), ('thnt', 0.125, 0.25),
    ('anea', 0.75, 0.0), ('anea', 0.0, 0.5)),
lexicon AS (SELECT word, avg(CAST(p AS DOUBLE)) - avg(CAST(n AS DOUBLE)) AS s
            FROM senses GROUP BY word),
hits AS (SELECT post_id, avg(s) AS mean
         FROM (SELECT post_id, unnest(toks) AS word FROM en) t JOIN lexicon USING (word)
         GROUP BY post_id),
scored AS (SELECT en.*, CAST(CASE WHEN mean > 0.1 THEN 1 WHEN mean < -0.1 THEN -1 ELSE 0 END
                             AS INTEGER) AS sentiment
           FROM en LEFT JOIN hits USING (post_id))"""

SHARES = SENTIMENT + """,
shares AS (SELECT post_id, uid, ouid, text, toks, sentiment, postedDate FROM scored
           WHERE verb = 'share')"""

EDGES = SHARES + """,
edges AS (SELECT uid AS src, ouid AS dst, CAST(count(*) AS DOUBLE) AS w
          FROM shares GROUP BY ALL)"""

CLICK_SHARES = SENTIMENT + """,
shares AS (SELECT post_id, uid, ouid, text, toks, sentiment, postedDate FROM scored
           WHERE verb = 'share' AND list_contains(toks, '#click'))"""

KIND = "CASE WHEN starts_with(term, '#') THEN '#' WHEN starts_with(term, '@') THEN '@' ELSE 'S' END"

ENTITY_COUNTS = TOKS + f""",
counts AS (SELECT postedDate, {KIND} AS kind, term, count(*) AS count
           FROM terms GROUP BY ALL)"""

GROUPS = """,
labels AS (SELECT id, CAST(CAST(substr(id, 2) AS BIGINT) % 5 AS BIGINT) AS community
           FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"""

PLANTED = EDGES + GROUPS

CLICK_PLANTED = CLICK_SHARES + EDGES[len(SHARES):] + GROUPS
