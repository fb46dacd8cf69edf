from collections import Counter
from datetime import datetime
from itertools import combinations

from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.operators import counters, ranking
from murmura.sources import counter_store as store

TOKS = [
    ("post", "2024-01-01", "ann", ["#a", "#b", "@x", "word"]),
    ("share", "2024-01-01", "bob", ["#a", "@x"]),
    ("post", "2024-01-02", "ann", ["#a", "#b", "@x", "word"]),
    ("post", "2024-01-01", "ann", ["#a", "#b", "@x", "word"]),
    ("post", "2024-01-01", "", ["#a"]),
    ("post", "2024-01-01", None, []),
]


def toks(spark):
    return spark.createDataFrame(TOKS, "verb string, postedDate string, AU string, toks array<string>")


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.collect()}


def test_pairs_against_brute_force(spark):
    want = Counter((d, *p) for _, d, _, t in TOKS for p in combinations(sorted(set(t)), 2))
    assert as_dict(counters.pair_counts(toks(spark)), "postedDate", "tok1", "tok2") == want
    total = Counter(p for _, _, _, t in TOKS for p in combinations(sorted(set(t)), 2))
    assert as_dict(counters.pair_counts(toks(spark), by=None), "tok1", "tok2") == total


def test_pairs_of_posts_with_a_long_whole_text(spark, small):
    # Brute force over whole documents on a small fixture; DuckDB would be too slow.
    rows = fx.toks(spark, small).limit(12)
    want = Counter(p for r in rows.collect() for p in combinations(sorted(set(r.toks)), 2))
    assert as_dict(counters.pair_counts(rows, by=None), "tok1", "tok2") == want


def test_pair_directions(spark):
    pairs = counters.pair_counts(toks(spark))
    both = as_dict(counters.both_directions(pairs), "postedDate", "tok1", "tok2")
    assert all(both[(d, b, a)] == n for (d, a, b), n in both.items())
    assert len(both) == 2 * pairs.count()


def test_authors_and_reach(spark):
    assert as_dict(counters.author_counts(toks(spark)), "postedDate", "author") == {
        ("2024-01-01", "ann"): 2, ("2024-01-01", "bob"): 1, ("2024-01-02", "ann"): 1}
    reach = as_dict(counters.hashtag_reach(toks(spark)), "postedDate", "hashtag")
    assert reach[("2024-01-01", "#a")] == 3
    assert counters.hashtag_author_counts(toks(spark)).filter("author = 'bob'").count() == 0


def test_replay_fold_and_read(spark, tmp_path):
    path = str(tmp_path / "s")
    counts = counters.entity_counts(toks(spark))
    now = datetime(2024, 1, 2)
    for batch in (0, 1, 1, 2):
        store.merge_counts(path, counts, batch, now)
    once = as_dict(counts, "postedDate", "kind", "term")
    want = {k: 3 * v for k, v in once.items()}
    assert as_dict(store.read_counts(spark, path), "postedDate", "kind", "term") == want
    store.fold_counts(spark, path, 1)
    assert as_dict(store.read_counts(spark, path), "postedDate", "kind", "term") == want
    store.merge_counts(path, counts, 2, now)
    store.fold_counts(spark, path, 2)
    assert as_dict(store.read_counts(spark, path), "postedDate", "kind", "term") == want


def test_expiry_slides_with_the_group(spark):
    rows = [("d1", "#", "a", 1, datetime(2024, 1, 1)), ("d1", "#", "b", 1, datetime(2024, 1, 9)),
            ("d1", "@", "c", 1, datetime(2024, 1, 1))]
    counts = spark.createDataFrame(
        rows, "postedDate string, kind string, term string, count long, updated_at timestamp")
    alive = store.expire_counts(counts, datetime(2024, 1, 10))
    assert {r.term for r in alive.collect()} == {"a", "b"}


def test_series_last_write_wins(spark):
    points = spark.createDataFrame(
        [("t", "d1", 5, 1), ("t", "d1", 3, 2), ("t", "d2", 9, 1)],
        "term string, postedDate string, count long, batch_id int")
    series = counters.term_series("#", points)
    assert as_dict(series, "term", "postedDate") == {("t", "d1"): 3, ("t", "d2"): 9}
    assert counters.series_map(series).first().points == {"d1": 3, "d2": 9}


def test_top_terms_has_exactly_n_and_ties_by_term(spark):
    counts = spark.createDataFrame([("d", "#", t, c) for t, c in
                                    [("#b", 2), ("#a", 2), ("#c", 5), ("#d", 1)]],
                                   "postedDate string, kind string, term string, count long")
    top = ranking.top_terms(counts, 2, "d").orderBy("rank").collect()
    assert [(r.rank, r.term) for r in top] == [(1, "#c"), (2, "#a")]
    assert ranking.term_count(counts, "d", "#A").first()["count"] == 2
    assert ranking.term_count(counts, "d", "#zz").first()["count"] == 0


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("count"))
    plan = ranking.top_n(df, ["g"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_days_report_reads_that_day_only(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge_counts(path, counters.entity_counts(toks(spark)), 0, datetime(2024, 1, 2))
    top = ranking.top_terms(store.read_counts(spark, path), 3, "2024-01-02")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(postedDate" in plan
    assert {r.postedDate for r in top.collect()} == {"2024-01-02"}


def test_late_batch_counts_after_a_fold(spark, tmp_path):
    from datetime import datetime
    path, now = str(tmp_path / "late"), datetime(2024, 1, 2)
    one = spark.createDataFrame([("a", 5)], "term string, count long")
    store.merge_counts(path, one, 3, now)
    store.fold_counts(spark, path, 3)
    store.merge_counts(path, one, -1, now)
    assert store.read_counts(spark, path).first()["count"] == 10
    store.fold_counts(spark, path, 3)
    store.merge_counts(path, one, 3, now)
    assert store.read_counts(spark, path).first()["count"] == 10


def test_sentiment_forms_agree(spark):
    from murmura.operators import sentiment as se
    lexicon = spark.createDataFrame([("good", 0.5, 0.0), ("good", 0.1, 0.0), ("bad", 0.0, 0.5)],
                                    "word string, positive double, negative double")
    posts = spark.createDataFrame(
        [(3, ["good"]), (3, ["bad"]), (None, ["good", "bad"]), (None, []), (4, None)],
        "post_id long, toks array<string>")
    both = [sorted((str(r.toks), r[2]) for r in f.collect()) for f in (
        se.score_by_join(posts, lexicon, "post_id", "toks"),
        se.score_by_lookup(posts.filter("toks is not null"), lexicon, "toks"))]
    assert [x for x in both[0] if x[0] != "None"] == both[1]


def test_stop_rule_of_the_layout():
    from murmura.operators.layout import slowed_down
    assert not slowed_down([1, 30, 40, 1], 20, 2)
    assert slowed_down([1, 30, 40, 1, 1.5], 20, 2)
    assert not slowed_down([5, 4, 3], 20, 1)


def test_pairs_of_a_long_post_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(counters, "PAIR_BLOCK", 4)
    sets = [[f"t{i:02}" for i in range(n)] for n in (0, 1, 2, 4, 5, 11, 11)] + [["b", "a", "a", None], None]
    toks = spark.createDataFrame([("d", s) for s in sets], "postedDate string, toks array<string>")
    found = {(r.tok1, r.tok2): r["count"] for r in counters.pair_counts(toks).collect()}
    want = {}
    for s in sets:
        own = sorted({t for t in s or [] if t})
        for pair in ((a, b) for i, a in enumerate(own) for b in own[i + 1:]):
            want[pair] = want.get(pair, 0) + 1
    assert found == want
