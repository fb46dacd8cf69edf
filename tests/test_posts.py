from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.functions.text import simple_tokens
from murmura.operators import enrich, sentiment


def test_lexicon_averages_senses_and_skips_nouns(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("# c\n\na\t1\t0.75\t0\tGood#1 fine#2\nv\t2\t0\t0.5\tgood#2\nn\t3\t1\t0\tgood#3\n")
    rows = {r.word: r for r in sentiment.load_lexicon(spark, str(path)).collect()}
    assert (rows["good"].positive, rows["good"].negative, rows["good"].senses) == (0.375, 0.25, 2)
    assert set(rows) == {"good", "fine"}


def scored(spark, how):
    posts = spark.createDataFrame(
        [("1", ["up", "x"]), ("2", ["down", "down2"]), ("3", ["x"]), ("4", []), ("5", None),
         ("6", ["up", "down"]), ("7", ["weak"])], "post_id string, toks array<string>")
    lexicon = spark.createDataFrame(
        [("up", 0.5, 0.0), ("down", 0.0, 0.5), ("down2", 0.0, 0.25), ("weak", 0.1, 0.0)],
        "word string, positive double, negative double")
    return {r.post_id: r.sentiment for r in how(posts, lexicon).collect()}


def test_both_scorings_agree_and_no_hit_is_neutral(spark):
    want = {"1": 1, "2": -1, "3": 0, "4": 0, "5": 0, "6": 0, "7": 0}
    assert scored(spark, sentiment.score_by_lookup) == want
    assert scored(spark, lambda p, l: sentiment.score_by_join(p, l, "post_id")) == want
    assert scored(spark, sentiment.score_sentiment) == want


def test_empty_lexicon(spark):
    none = spark.createDataFrame([], "word string, positive double, negative double")
    posts = spark.createDataFrame([("1", ["a"])], "post_id string, toks array<string>")
    assert sentiment.score_by_lookup(posts, none).first().sentiment == 0


def test_large_lexicon_takes_the_join(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "BROADCAST_ROWS", 1)
    want = {"1": 1, "2": -1, "3": 0, "4": 0, "5": 0, "6": 0, "7": 0}
    assert scored(spark, sentiment.score_sentiment) == want


def test_exclusion_is_a_substring_and_drops_missing_bodies(spark):
    df = spark.createDataFrame([("a #jobless x",), ("#JOB",), (None,), ("fine",)], "body string")
    assert [r.body for r in enrich.exclude_bodies(df).collect()] == ["#JOB", "fine"]
    assert enrich.exclude_bodies(df, []).count() == 3


def test_terms_match_whole_tokens_at_any_place(spark):
    df = spark.createDataFrame([(1, ["#go"]), (2, ["x", "#go"]), (3, ["#going"]), (4, ["a.b"])],
                               "id int, toks array<string>")
    assert {r.id for r in enrich.filter_terms(df, " #GO ,zzz").collect()} == {1, 2}
    assert enrich.filter_terms(df, ["axb"]).count() == 0


def test_topic_needs_blanks_around(spark):
    df = spark.createDataFrame([("x #Go y",), ("#go y",), ("x #goa y",), ("c++ c++ c",)], "body string")
    assert enrich.filter_topic(df, ["#go"]).count() == 1
    assert enrich.filter_topic(df, ["c++"]).count() == 1


def test_missing_id_gets_a_digest(spark, small):
    acts = fx.activities(spark, small).withColumn("id", F.lit(None).cast("string"))
    ids = enrich.with_post_id(acts).select("post_id")
    assert ids.filter(F.length("post_id") == 64).distinct().count() == acts.count()


def test_full_tokenizer_pipeline_runs_without_row_python(spark, small):
    posts = enrich.with_tokens(enrich.english(enrich.with_post_id(fx.activities(spark, small))))
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert posts.filter(F.size("toks") == 0).count() == 0


def test_tokens_are_computed_once_for_counts(spark, small):
    from murmura.operators import counters
    df = counters.entity_counts(fx.toks(spark, small))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # one per text: own and shared


def test_simple_tokens_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(simple_tokens("t").alias("x")).first().x is None


def test_tags_alone_equal_the_tags_of_all_tokens(spark):
    from murmura.functions.text import simple_tokens, tags_and_handles
    from murmura.functions.tweet_tokens import tweet_tokens

    rows = [("Don't #Stop @Bob's bob's '#x http://a.co/#frag 12 #12 @a", "RT @Bob: #stop it's #É"),
            ("##a a#b @@c #'s 's#d", None), (None, None), ("no tags", "")]
    posts = spark.createDataFrame(
        [("2024-01-01T00:00:00.000Z", a, (b,)) for a, b in rows],
        "postedTime string, body string, object struct<body: string>")
    for tokenizer in (simple_tokens, tweet_tokens):
        every = enrich.with_tokens(posts, tokenizer=tokenizer)
        tags = enrich.with_tokens(posts, tokenizer=tokenizer, tags_only=True)
        wanted = [r[0] for r in every.select(tags_and_handles("toks")).collect()]
        assert [r.toks for r in tags.collect()] == wanted
        assert any(wanted)


def test_excluded_bodies_by_texts_and_patterns(spark):
    posts = spark.createDataFrame([("a #job",), ("x13",), ("fine",), (None,)], "body string")
    kept = enrich.exclude_bodies(posts, ["#job", "#t13"])
    assert [r.body for r in kept.collect()] == ["x13", "fine"]
    assert "RLIKE" not in kept._jdf.queryExecution().optimizedPlan().toString()
    mixed = enrich.exclude_bodies(posts, ["#job", "x[0-9]+"])
    assert [r.body for r in mixed.collect()] == ["fine"]


def test_related_terms_tokenize_posts_once(spark, tmp_path, monkeypatch):
    from murmura.catalog import fixtures, words

    made = []
    whole = fixtures.toks
    monkeypatch.setattr(fixtures, "toks", lambda *a, **k: made.append(k) or whole(*a, **k))
    days = 40
    spark.range(days).selectExpr(
        "id AS event_id", "timestamp'2024-01-15 10:00:00' AS ts", "id % 4 AS user_id",
        "'click' AS event_type", "1.0D AS value", """'{"k": 1}' AS props"""
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 0L AS doc_id, 'some words' AS text, 'en' AS lang").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = {r.word: r["count"] for r in words.related_terms(spark, str(tmp_path)).collect()}
    assert made == [{"tags_only": True}]
    assert found == {"#t1": days}
