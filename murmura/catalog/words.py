"""Embeddings, nearest vectors, related terms, topics; and streams."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.catalog.registry import query
from murmura.operators import counters, enrich, ranking, vectors
from murmura.plans import reports
from murmura.plans.ingest import Ingest
from murmura.runtime import materialize, scratch_path
from murmura.schema import DATE
from murmura.sources import activities as files
from murmura.sources import counter_store as store
from murmura.sources import registry, tables
from murmura.streaming import closing, current_counts, start_counts, start_ingest, windowed_entity_counts

DAY = "2024-01-15"


def _centres(table: DataFrame) -> DataFrame:
    """Mean vector per label; one row per label."""
    return (table.select("label", array_to_vector("embedding").alias("v")).groupBy("label")
            .agg(Summarizer.mean(F.col("v")).alias("m"))
            .select(F.col("label").alias("query_id"), vector_to_array("m").alias("query_vector")))


_NEAREST = """WITH dims AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
  FROM embeddings),
centre AS (SELECT label, list(m ORDER BY i) AS q
           FROM (SELECT label, i, avg(v) AS m FROM dims GROUP BY label, i) GROUP BY label),
scored AS (SELECT c.label AS query_id, vec_id AS id, round(list_cosine_similarity(
             CAST(embedding AS DOUBLE[]), q), 9) AS s, e.label AS own
           FROM embeddings e CROSS JOIN centre c),
ranked AS (SELECT query_id, id, round(s, 6) AS similarity, CAST(row_number() OVER (
             PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM scored {where})
SELECT * FROM ranked WHERE rank <= 10"""


@query(_NEAREST.format(where=""))
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors closest to the centre of each label."""
    table = fx.table(spark, sf_dir, "embeddings")
    found = vectors.nearest_vectors(table, _centres(table), 10, "vec_id", "embedding")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_NEAREST.format(where="WHERE own >= 5"))
def nearest_vectors_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are filtered before ranking, so 10 are found."""
    table = fx.table(spark, sf_dir, "embeddings")
    found = vectors.nearest_vectors(table, _centres(table), 10, "vec_id", "embedding",
                                    where=F.col("label") >= 5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(v), 6) AS mean FROM (
  SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
GROUP BY i""")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = vectors.vector_mean(fx.table(spark, sf_dir, "embeddings"), "embedding")
    return mean.select(F.posexplode("mean").alias("dim", "m")).select(
        "dim", F.round("m", 6).alias("mean"))


@query("""WITH dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS d FROM dims)
SELECT vec_id, round(sum(d), 6) AS total, round(max(d), 6) AS largest FROM (
  SELECT vec_id, d / sqrt(sum(d * d) OVER (PARTITION BY vec_id)) AS d FROM c) GROUP BY vec_id""")
def centred_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors less their mean, scaled to length 1; sum and largest part of each."""
    unit = vectors.centre_and_scale(fx.table(spark, sf_dir, "embeddings"), "embedding")
    parts = unit.select("vec_id", vector_to_array("unit").alias("u"))
    return parts.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("u"), 6).alias("largest"))


@query()
def projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two principal components."""
    return vectors.project_terms(fx.table(spark, sf_dir, "embeddings"), 2, "embedding").select(
        "vec_id", "label", "pca")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token table of hashtags and handles, all that models are trained on."""
    return materialize(fx.toks(spark, sf_dir, tags_only=True), "tags")


def _words(tags: DataFrame) -> DataFrame:
    model = vectors.train_terms(tags, vector_size=20, iterations=2, partitions=2)
    return materialize(vectors.model_vectors(model), "words")


@query()
def trained_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary and vectors of a model trained on hashtags and handles."""
    return _words(_tags(spark, sf_dir))


@query()
def trained_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over ten days of words."""
    model = vectors.train_terms_window(_tags(spark, sf_dir), "2024-01-05", 10,
                                       vector_size=10, iterations=1)
    return vectors.model_vectors(model)


@query(f"""WITH {fx.TOKS}, tags AS (SELECT postedDate, term FROM terms
  WHERE starts_with(term, '#') OR starts_with(term, '@')),
starts AS (SELECT CAST(range AS DATE) AS d FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 10 DAY)),
w AS (SELECT strftime(d, '%Y-%m-%d') AS start, strftime(least(d + 10, DATE '2024-02-01'), '%Y-%m-%d') AS stop,
             CAST(least(10, DATE '2024-02-01' - d) AS INTEGER) AS days FROM starts),
c AS (SELECT start, days, term, count(*) AS n FROM w JOIN tags ON postedDate >= start AND postedDate < stop
      GROUP BY ALL)
SELECT start, days, count(*) FILTER (n >= 5 * days) AS words,
       CASE WHEN count(*) FILTER (n >= 5 * days) > 0 THEN 'trained' ELSE 'failed' END AS status
FROM w LEFT JOIN c USING (start, days) GROUP BY start, days""")
def trained_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models over consecutive 10-day windows of the month, several at a time."""
    return vectors.train_windows(_tags(spark, sf_dir), "2024-01-01", "2024-02-01", 10).select(
        "start", "days", "words", "status")


@query("""WITH dims AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS d FROM dims),
u AS (SELECT vec_id, i, d / sqrt(sum(d * d) OVER (PARTITION BY vec_id)) AS d FROM c),
total AS (SELECT sum(s) AS t FROM (SELECT var_pop(d) AS s FROM u GROUP BY i))
SELECT vec_id, round((SELECT t FROM total), 6) AS total_variance, true AS falling,
       CAST(0 AS BIGINT) AS correlated
FROM embeddings WHERE vec_id IN (1, 2, 3, 5, 8, 13)""")
def projected_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a few rows among all principal components, which keep the whole variance."""
    table = fx.table(spark, sf_dir, "embeddings")
    size = table.select(F.size("embedding").alias("n")).first()["n"]
    every = materialize(vectors.project_terms(table, size, "embedding").select("vec_id", "pca"), "pca")
    spread = every.agg(*[F.var_pop(F.col("pca")[i]).alias(f"v{i}") for i in range(size)],
                       *[F.covar_pop(F.col("pca")[i], F.col("pca")[i + 1]).alias(f"c{i}")
                         for i in range(3)])
    facts = spread.select(
        F.round(sum(F.col(f"v{i}") for i in range(size)), 6).alias("total_variance"),
        reduce(lambda a, b: a & b, [F.col(f"v{i}") + 1e-9 >= F.col(f"v{i + 1}")
                                    for i in range(size - 1)]).alias("falling"),
        sum((F.abs(f"c{i}") > 1e-6).cast("long") for i in range(3)).alias("correlated"))
    picked = vectors.project_topic(table, [1, 2, 3, 5, 8, 13], 2, "vec_id", "embedding")
    return picked.select("vec_id", *[facts.select(c).scalar().alias(c) for c in facts.columns])


@query()
def trained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per day; a day without posts is recorded as failed."""
    return vectors.train_range(_tags(spark, sf_dir), "2023-12-31", "2024-01-02", vector_size=10, iterations=1,
                               min_count=2)


@query()
def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related-terms report: words, similarity and count of the day."""
    tags = _tags(spark, sf_dir)
    return reports.related_terms(_words(tags), counters.entity_counts(tags), DAY, "#click", 10)


@query()
def curated_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.curate_topic(_words(_tags(spark, sf_dir)), "#click", 10)


@query()
def topic_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each community in the topic story."""
    shares = materialize(fx.shares(spark, sf_dir), "shares")
    # The derived share text has no tags of its own, so they are put in front.
    tagged = shares.withColumn("body", F.concat(
        F.lit(" "), F.array_join(enrich.tx.tags_and_handles("toks"), " "), F.lit(" "), "body"))
    story = reports.topic_story(tagged, _words(_tags(spark, sf_dir)), "#click")
    return story.words


@query()
def related_terms_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer of the related-terms report."""
    tags = _tags(spark, sf_dir)
    counts = counters.entity_counts(tags)
    found = reports.related_terms(_words(tags), counts, DAY, "#click", 5)
    return reports.related_terms_json(found, "#click", ranking.term_count(counts, DAY, "#click"))


@query()
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two daily models saved; the registry names the newer one."""
    folder = scratch_path(spark, "models")
    toks = _tags(spark, sf_dir)
    for day in (1, 2):
        date = f"2024-01-0{day}"
        model = vectors.train_terms(toks.filter(F.col(DATE) == date), vector_size=10,
                                    iterations=1, min_count=2)
        registry.save_model(model, folder, date, datetime(2024, 1, day), spark)
    models = spark.read.parquet(f"{folder}/registry").agg(F.count("*").alias("models"))
    return registry.latest_model(spark, folder).select("date", models.scalar().alias("models"))


def _record_files(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "incoming")
    files.write_activities(fx.activities(spark, sf_dir), folder)
    return folder


@query(f"WITH {fx.ENTITY_COUNTS} SELECT postedDate, kind, term, count FROM counts")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job as a file stream in several micro-batches: same counts."""
    folder = _record_files(spark, sf_dir)
    job = Ingest(scratch_path(spark, "ingest"), fx.lexicon(spark), fx.EXCLUDED,
                 rebalance=True, enrich=fx.PLAIN)
    stream = files.read_activity_stream(spark, folder, files_per_trigger=3)
    start_ingest(stream, job, scratch_path(spark, "checkpoint"), None).awaitTermination()
    return job.read_counts(spark).drop("updated_at")


@query(f"""WITH {fx.EN}, terms AS (SELECT postedDate, unnest(toks) AS term FROM en)
SELECT postedDate, {fx.KIND} AS kind, term, count(*) AS count FROM terms GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per day kept in Spark's streaming state."""
    folder = _record_files(spark, sf_dir)
    path = scratch_path(spark, "windows")
    # Files hold posts of the whole month in any order, hence the wide watermark.
    counts = windowed_entity_counts(
        files.read_activity_stream(spark, folder, files_per_trigger=4), watermark="40 days",
        **fx.PLAIN)
    start_counts(counts, path, scratch_path(spark, "checkpoint"), None).awaitTermination()
    latest = current_counts(spark.read.parquet(path), "start", "kind", "term")
    return latest.select(F.date_format("start", "yyyy-MM-dd").alias(DATE), "kind", "term", "count")


@query(f"""WITH {fx.TOKS}
SELECT postedDate, uid AS author, count(*) AS count FROM toks GROUP BY ALL""")
def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job over JSON files, run twice as one batch: authors count once."""
    folder = _record_files(spark, sf_dir)
    job = Ingest(scratch_path(spark, "ingest"), fx.lexicon(spark), fx.EXCLUDED,
                 rebalance=True, enrich=fx.PLAIN)
    for _ in range(2):
        job.run(files.read_activities(spark, f"{folder}/*.json.gz"), 0)
    return job.read_counts(spark, "authors").drop("updated_at")


@query(f"""WITH {fx.EN},
mark AS (SELECT max(ts) - INTERVAL 2 DAY AS passed FROM f JOIN documents d ON f.event_id % (
    SELECT nd FROM n) = d.doc_id WHERE lang = 'en'),
used AS (SELECT postedDate, unnest(toks) AS term,
                postedDate <= '2024-01-10' AND CAST(post_id AS BIGINT) % 7 = 0 AS tardy FROM en)
SELECT postedDate, {fx.KIND} AS kind, term, count(*) FILTER (NOT tardy) AS count,
       count(*) FILTER (tardy) AS late
FROM used, mark WHERE CAST(postedDate AS DATE) + INTERVAL 1 DAY <= passed GROUP BY ALL""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final counts of closed days over four batches, and what came after their day was closed."""
    # Each part is made when it arrives: its days are picked before texts are joined.
    records = fx.activities(spark, sf_dir)
    day = F.substring("postedTime", 1, 10)
    tardy = (day <= "2024-01-10") & (F.col("id").cast("bigint") % 7 == 0)
    parts = [(day <= "2024-01-10") & ~tardy, (day > "2024-01-10") & (day <= "2024-01-20"),
             day > "2024-01-20", tardy]
    inbox, path, checkpoint = (scratch_path(spark, x) for x in ("inbox", "closed", "checkpoint"))
    counts = None
    for part in parts:
        records.filter(part).write.mode("append").option("compression", "gzip").json(inbox)
        counts = counts or windowed_entity_counts(
            files.read_activity_stream(spark, inbox), watermark="2 days", **fx.PLAIN)
        closing.start_closed(counts, path, checkpoint, None).awaitTermination()
    posts = enrich.with_tokens(enrich.english(enrich.with_post_id(
        files.read_activities(spark, inbox))), **fx.PLAIN)
    return closing.late_counts(counters.entity_counts(enrich.token_table(posts)),
                               closing.read_closed(spark, path))


@query(f"""WITH {fx.ENTITY_COUNTS}, judged AS (
  SELECT *, postedDate >= '{DAY}' OR (kind = '#' AND postedDate < '2024-01-08') AS alive FROM counts)
SELECT postedDate, kind, alive, CAST(CASE WHEN alive THEN sum(count) END AS BIGINT) AS uses
FROM judged GROUP BY postedDate, kind, alive""")
def expired_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timer per (date, kind): groups without updates for a week leave state, store and folders."""
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    counts = materialize(counters.entity_counts(fx.toks(spark, sf_dir)), "counts")
    old, again = F.col(DATE) < DAY, (F.col(DATE) < "2024-01-08") & (F.col("kind") == "#")
    steps = [(old & ~again, datetime(2024, 1, 15)), (again, datetime(2024, 1, 15, 1)),
             # The next batch adds nothing to the counts, it only renews its groups.
             (again, datetime(2024, 1, 21)), (~old, datetime(2024, 1, 24))]
    for batch, (part, when) in enumerate(steps):
        rows = counts.filter(part)
        if batch == 2:
            rows = rows.withColumn("count", F.lit(0).cast("long"))
        store.merge_counts(path, rows, batch, when)
        closing.start_expiry(spark, path, checkpoint, interval=None).awaitTermination()
    left = store.read_counts(spark, path).groupBy(DATE, "kind").agg(F.sum("count").alias("uses"))
    return counts.select(DATE, "kind").distinct().join(left, [DATE, "kind"], "left").select(
        DATE, "kind", F.col("uses").isNotNull().alias("alive"), "uses")


@query(f"""WITH {fx.EN}
SELECT postedDate, verb, count(*) AS posts, CAST(sum(len(toks)) AS BIGINT) AS tokens,
       CAST(2 AS BIGINT) AS merges FROM en GROUP BY ALL""")
def compacted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in twelve batch folders, merged in two steps; a batch written again counts once."""
    root = scratch_path(spark, "posts")
    posts = materialize(fx.unscored(spark, sf_dir), "posts")
    parts = [posts.filter(F.pmod(F.xxhash64("post_id"), F.lit(12)) == i) for i in range(12)]
    for batch, part in enumerate(parts):
        tables.write_batch(part, root, batch)
        if batch in (4, 9):
            tables.compact_table(spark, root, batch, remove=batch == 9)
    tables.write_batch(parts[2], root, 2)
    merges = spark.read.parquet(f"{root}_merged").agg(F.count_distinct("upto")).scalar()
    return tables.read_table(spark, root).groupBy(DATE, "verb").agg(
        F.count("*").alias("posts"), F.sum(F.size("toks").cast("long")).alias("tokens")
    ).withColumn("merges", merges)
