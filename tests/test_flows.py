import json
import os
import shutil
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.catalog import fixtures as fx
from murmura.operators import counters, enrich, vectors
from murmura.plans import reports
from murmura.plans.ingest import Ingest, backfill
from murmura.runtime import scratch_path
from murmura.sources import activities as files
from murmura.sources import registry, tables
from murmura.streaming import start_ingest


def part_files(folder):
    return sorted(p for p in folder.iterdir() if p.name.endswith(".json.gz"))


def test_stream_equals_batch_skips_unfinished_files_and_restarts(spark, small, tmp_path):
    made, inbox = tmp_path / "made", tmp_path / "inbox"
    acts = fx.activities(spark, small)
    files.write_activities(acts.repartition(4), str(made))
    inbox.mkdir()
    parts = part_files(made)
    for age, p in enumerate(parts[:2]):
        shutil.copy(p, inbox / p.name)
        os.utime(inbox / p.name, (1_700_000_000 + age, 1_700_000_000 + age))  # fixes the order
    shutil.copy(parts[2], inbox / (parts[2].name + "_WRITING_"))
    job = Ingest(str(tmp_path / "out"), fx.lexicon(spark), fx.EXCLUDED, rebalance=True,
                 enrich=fx.PLAIN)

    def run():
        stream = files.read_activity_stream(spark, str(inbox), files_per_trigger=1)
        start_ingest(stream, job, str(tmp_path / "check"), None).awaitTermination()

    def same_as(paths):
        posts = fx.enrich.enrich_posts(files.read_activities(spark, paths), fx.lexicon(spark), **fx.PLAIN)
        want = counters.entity_counts(enrich.token_table(enrich.exclude_bodies(posts, fx.EXCLUDED)))
        got = job.read_counts(spark).select("postedDate", "kind", "term", "count")
        return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    run()
    assert same_as([str(p) for p in parts[:2]])
    for p in parts[2:]:
        shutil.copy(p, inbox / p.name)
    run()
    assert same_as([str(p) for p in parts])
    # A batch that is run again replaces its own output.
    job.run(files.read_activities(spark, [str(parts[0])]), 0)
    assert same_as([str(p) for p in parts])
    before = job.read_posts(spark).count()
    backfill(spark, job, f"{parts[0]} {parts[1]}")
    assert job.read_posts(spark).count() > before


def test_ingest_without_english_posts(spark, small, tmp_path):
    job = Ingest(str(tmp_path / "out"), fx.lexicon(spark), enrich=fx.PLAIN, pairs=False,
                 author_tags=True)
    job.run(fx.activities(spark, small).withColumn("twitter_lang", F.lit("xx")), 0)
    assert job.read_counts(spark).count() == 0


def test_dates_prune_folders(spark, small, tmp_path):
    root = str(tmp_path / "toks")
    tables.write_tokens(fx.toks(spark, small), root)
    day = enrich.slice_dates(tables.read_table(spark, root), "2024-01-03", "2024-01-05")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(cast" in plan
    assert sorted(r.postedDate for r in day.select("postedDate").distinct().collect()) == [
        "2024-01-03", "2024-01-04"]


def test_replace_mode_touches_only_its_dates(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "postedDate string, v int")
    tables.write_partitioned(rows, root)
    tables.write_partitioned(rows.filter("v = 2").withColumn("v", F.lit(9)), root, mode="replace")
    assert {r.v for r in tables.read_table(spark, root).collect()} == {1, 9}


def test_edge_file_with_and_without_weights(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a b\nb c 2.5\n")
    rows = tables.read_edges(spark, str(tmp_path / "e.txt"), " ").collect()
    assert [(r.src, r.dst, r.w) for r in rows] == [("a", "b", 1.0), ("b", "c", 2.5)]


def test_nearest_vectors_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows.append(("v200", rows[3][1]))  # an exact copy ties; the smaller id comes first
    rows.append(("zero", [0.0] * 8))
    table = spark.createDataFrame(rows, "id string, vector array<double>").repartition(5)
    asked = table.filter("id < 'v007'").select(F.col("id").alias("query_id"),
                                               F.col("vector").alias("query_vector"))
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1) for k, v in rows}
    want = {(q, r + 1): k for q in (f"v{i:03d}" for i in range(7)) for r, k in enumerate(sorted(
        unit, key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))[:4])}
    for passes in (1024, 2):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", passes)
        got = vectors.nearest_vectors(table, asked, 4).collect()
        assert {(r.query_id, r["rank"]): r.id for r in got} == want


def test_related_terms_and_topic(spark):
    words = spark.createDataFrame(
        [("#a", [1.0, 0.0]), ("#b", [0.9, 0.1]), ("@c", [1.0, 0.01]), ("#d", [0.0, 1.0])],
        "word string, vector array<double>")
    counts = spark.createDataFrame([("d", "#", "#b", 7)],
                                   "postedDate string, kind string, term string, count long")
    got = reports.related_terms(words, counts, "d", "#A", 5)
    assert [(r.word, r["count"]) for r in got.collect()] == [("#b", 7), ("#d", 0)]
    assert vectors.related_terms(words, "#zz", 5).count() == 0
    assert [r.word for r in vectors.curate_topic(words, "#a", 2).orderBy("rank").collect()] == ["#a", "#b"]
    term = spark.createDataFrame([(3,)], "count long")
    answer = json.loads(reports.related_terms_json(got, "#a", term).first().response)
    assert answer["searchTermCount"] == 3 and [d[0] for d in answer["distance"]] == ["#b", "#d"]
    empty = reports.related_terms(words, counts, "d", "#zz", 5)
    assert json.loads(reports.related_terms_json(empty, "#zz", term).first().response)["distance"] == []


def test_models_are_saved_announced_and_replaced(spark, tmp_path):
    toks = spark.createDataFrame([("d", ["#a", "#b", "w"])] * 20, "postedDate string, toks array<string>")
    model = vectors.train_terms(toks, vector_size=4, iterations=1, partitions=1, min_count=2)
    assert {r.word for r in vectors.model_vectors(model).collect()} == {"#a", "#b"}
    for day in (1, 2):
        registry.save_model(model, str(tmp_path), f"2024-01-0{day}", datetime(2024, 1, day))
    assert registry.load_latest(spark, str(tmp_path))[0] == "2024-01-02"
    old = registry.latest_model(spark, str(tmp_path), before=datetime(2024, 1, 1, 12)).first()
    assert old.date == "2024-01-01"


def test_training_windows():
    assert vectors.window_starts("2024-01-01", "2024-01-08", 3) == [
        "2024-01-01", "2024-01-04", "2024-01-07"]
    assert vectors.window_starts("2024-01-02", "2024-01-02", 3) == []


def test_membership_is_replaced_and_expires(spark, tmp_path):
    root, now = str(tmp_path / "m"), datetime(2024, 1, 1, 12, 0)
    labels = spark.createDataFrame([("u1", 0), ("u2", 1)], "id string, community long")
    registry.save_membership(root, "k", labels, now)
    registry.save_membership(root, "k", labels.filter("id = 'u1'"), now)
    registry.save_membership(root, "other", labels, now)
    assert registry.read_membership(spark, root, "k", datetime(2024, 1, 1, 12, 9)).count() == 1
    assert registry.read_membership(spark, root, "k", datetime(2024, 1, 1, 12, 11)).count() == 0


def test_communities_then_details(spark, small, tmp_path):
    shares = fx.shares(spark, small).persist()
    now = datetime(2024, 1, 1)
    found = reports.communities(shares, "#CLICK", coverage=0.9, layout_rounds=2)
    found.save(str(tmp_path), now)
    key = reports.key_of(spark, " #click")
    assert key == found.query_key
    members = registry.read_membership(spark, str(tmp_path), key, now)
    mood, words = reports.community_details(shares, "#click", members, 3)
    answers = reports.community_details_json(mood, words).collect()
    assert {r.community for r in answers} <= {r.community for r in members.collect()}
    assert all(len(json.loads(r.response)["wordcloud"]) == 3 for r in answers)
    node = json.loads(reports.community_nodes_json(found.nodes).first().value)
    assert len(node) == 7 and isinstance(node[2], int) and node[6] == 0.0
    edge = json.loads(reports.community_edges_json(found.nodes, found.edges).first().value)
    assert len(edge) == 4 and float(edge[3]) >= 1
    shares.unpersist()


def test_shared_folder_must_be_given_on_a_cluster(spark, monkeypatch):
    from murmura import runtime

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session)


def test_nearest_vectors_of_unlike_lengths_in_blocks(spark, monkeypatch):
    from murmura.operators import vectors as v
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=(2, 4)[i % 2]).tolist()) for i in range(60)] + [(60, None), (61, [0.0, 0.0])]
    asked = [(f"q{i}", rng.normal(size=(4, 2, 3)[i % 3]).tolist()) for i in range(9)] + [("qn", None)]
    have = spark.createDataFrame(rows, "id long, vector array<double>")
    want = {}
    for name, q in asked:
        scores = [(-round(float(np.dot(q, x) / np.linalg.norm(q) / (np.linalg.norm(x) or 1)), 9), i)
                  for i, x in rows if q and x and len(x) == len(q)]
        want |= {(name, rank): i for rank, (_, i) in enumerate(sorted(scores)[:5], 1)}
    query = spark.createDataFrame(asked, "query_id string, query_vector array<double>")
    for block, cell in ((1024, 16_384), (2, 7)):
        monkeypatch.setattr(v, "QUERY_BLOCK", block)
        monkeypatch.setattr(v, "VECTOR_CELL", cell)
        found = v.nearest_vectors(have, query, 5).collect()
        assert {(r.query_id, r["rank"]): r.id for r in found} == want


def test_expired_groups_leave_the_store(spark):
    from murmura.sources import counter_store as store
    path = scratch_path(spark, "counts")
    def add(batch, date, n, day):
        rows = spark.createDataFrame([(date, "#", "#a", n)], "postedDate string, kind string, term string, count long")
        store.merge_counts(path, rows, batch, datetime(2024, 1, day))
    for batch in range(12):
        add(batch, f"2024-01-0{1 + batch % 3}", 1, 2 + (batch % 3) * 5)
    assert len(store.expire_store(spark, path, datetime(2024, 1, 12))) == 12
    add(1, "2024-01-02", 1, 12)  # a repeated batch
    add(20, "2024-01-03", 5, 12)
    now = {r.postedDate: r["count"] for r in store.read_counts(spark, path).collect()}
    assert now == {"2024-01-02": 4, "2024-01-03": 9}
    assert "folded/folded_to=0" in store.expire_store(spark, path, datetime(2024, 1, 19))
    assert {r.postedDate for r in store.read_counts(spark, path).collect()} == {"2024-01-03"}
