"""Plans and files that decide how queries grow, on rows of their own."""

import threading
import time
from collections import Counter
from datetime import datetime
from itertools import combinations
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from murmura import runtime
from murmura.catalog import counts as queries
from murmura.catalog import graphs
from murmura.functions.text import simple_tokens
from murmura.operators import counters, sentiment
from murmura.plans.ingest import Ingest
from murmura.runtime import at_once
from murmura.sources import activities as files
from murmura.sources import counter_store, tables
from murmura.streaming import windowed_entity_counts

PLAIN = {"stop_words": ["the"], "tokenizer": simple_tokens}


def plan(df):
    return df._jdf.queryExecution().toString()


def records(spark, n=40):
    body = F.concat(F.lit("Alpha #tag"), F.col("id") % 5, F.lit(" the word"), F.col("id") % 7)
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("post").alias("verb"),
        F.concat(F.lit("2024-01-0"), F.col("id") % 3 + 1, F.lit("T10:00:00.000Z")).alias("postedTime"),
        body.alias("body"), F.lit("en").alias("twitter_lang"),
        F.struct(F.concat(F.lit("u"), F.col("id") % 4).alias("preferredUsername")).alias("actor"),
        F.lit(None).cast("struct<body:string,actor:struct<preferredUsername:string>>").alias("object"))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(counters, "TASK_PAIRS", 10)
    sets = [["a", "b", "c", None, "c"], ["b", "a"], ["a", "b"], ["x"], [], None,
            [f"w{i:02}" for i in range(12)]]
    found = counters.pair_counts(spark.createDataFrame([(s,) for s in sets], "toks array<string>"),
                                 by=None)
    wanted = Counter(p for s in sets for p in combinations(sorted({t for t in s or [] if t}), 2))
    assert {(r.tok1, r.tok2): r["count"] for r in found.collect()} == wanted
    assert "7), REPARTITION_BY_NUM" in plan(found)  # 70 pairs


def test_pairs_are_packed_before_they_are_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([("d1", ["a", "b", "c"]), (None, ["b", "a"]), ("d1", ["c", "b"])],
                                 "postedDate string, toks array<string>")
    found = counters.pair_counts(rows)
    assert {(r.postedDate, r.tok1, r.tok2): r["count"] for r in found.collect()} == {
        ("d1", "a", "b"): 1, ("d1", "a", "c"): 1, ("d1", "b", "c"): 2, (None, "a", "b"): 1}
    assert "FlatMapGroupsInArrow" in plan(found) and "Generate inline" not in plan(found)
    # Parts are handed on and added up whatever a task may hold.
    monkeypatch.setattr(counters, "HELD_PAIRS", 6)
    monkeypatch.setattr(counters, "HELD_WORDS", 5)
    monkeypatch.setattr(counters, "ROWS", 1)
    sets = [[f"w{j:02}" for j in range(i % 7, 9)] for i in range(30)]
    batch = pa.record_batch([
        pa.array([None if i % 3 == 0 else "k" for i in range(60)], pa.string()), pa.array([i % 4 + 1 for i in range(60)], pa.int64()),
        pa.array(sets * 2, pa.list_(pa.string())),
        pa.array([None] * 30 + [["x", "y"]] * 30, pa.list_(pa.string()))], ["_group", "_n", "_a", "_b"])
    wanted = Counter()
    for i in range(60):
        own = combinations(sets[i % 30], 2) if i < 30 else ((t, u) for t in sets[i % 30] for u in "xy")
        wanted.update({(None if i % 3 == 0 else "k", *pair): i % 4 + 1 for pair in own})
    parts = list(counters._pair_counter(pa.string(), 3)(iter([batch])))
    schema = pa.schema([("_group", pa.string()), ("tok1", pa.string()), ("tok2", pa.string()), ("count", pa.int64())])
    got = Counter()
    for bucket in range(3):
        table = pa.Table.from_batches([p for p in parts if p.column(0)[0].as_py() == bucket], parts[0].schema)
        for r in counters._pair_adder(schema)(table).to_pylist() if len(table) else []:
            assert tuple(r.values())[:3] not in got
            got[tuple(r.values())[:3]] = r["count"]
    assert len(parts) > 6 and got == wanted


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_written_tables_drop_their_shuffle_files(spark, tmp_path):
    held, before = shuffle_files(spark), spark.conf.get(runtime.CLEANUP)
    rows = records(spark, 500).repartition(3, "id").withColumn("postedDate", F.substring("postedTime", 1, 10))
    assert runtime.materialize(rows, "rows").toArrow().num_rows == 500
    tables.write_posts(rows, str(tmp_path / "posts"))
    for batch in range(2):
        tables.write_batch(rows, str(tmp_path / "batches"), batch, rebalance=True)
    tables.compact_table(spark, str(tmp_path / "batches"), 1)
    counter_store.merge_counts(str(tmp_path / "store"), rows.groupBy("postedDate").count(), 0, datetime(2024, 1, 1))
    files.write_activities(rows, str(tmp_path / "json"))
    left = time.time() + 20
    while shuffle_files(spark) - held and time.time() < left:
        time.sleep(0.5)
    assert not shuffle_files(spark) - held
    assert spark.conf.get(runtime.CLEANUP) == before


def test_slice_is_placed_before_it_is_tokenized(spark, small, monkeypatch):
    seen, write = [], graphs.tables.write_posts
    monkeypatch.setattr(graphs.tables, "write_posts",
                        lambda posts, *rest, **kw: (seen.append((plan(posts), kw)), write(posts, *rest, **kw)))
    assert graphs.loaded_slice(spark, small).count() > 0
    (text, kw), = seen
    assert "RebalancePartitions" in text and kw == {"rebalance": False}


def test_join_form_groups_hits_and_not_sets(spark):
    lexicon = spark.createDataFrame([("good", 0.5, 0.0), ("bad", 0.0, 0.5), ("so", 0.0, 0.05)],
                                    "word string, positive double, negative double")
    rows = [(1, ["good", "so"]), (1, ["bad", "bad", "good"]), (None, ["plain"]), (2, []), (3, None),
            (4, [None, "good"]), (4, ["null", "bad"])]
    posts = spark.createDataFrame(rows, "post_id long, toks array<string>")
    joined = sentiment.score_by_join(posts, lexicon, "post_id")
    wanted = [1, -1, 0, 0, 0, 1, -1]
    key = str
    assert sorted(((r.post_id, r.toks, r.sentiment) for r in joined.collect()), key=key) == sorted(
        ((i, t, s) for (i, t), s in zip(rows, wanted)), key=key)
    assert "hashpartitioning(toks" not in plan(joined).replace("#", "")


def test_series_and_expiry_tokenize_once(spark, small, monkeypatch):
    assert "regexp_extract_all" not in plan(queries.term_series(spark, small))
    seen, merge = [], counter_store.merge_counts
    monkeypatch.setattr(queries.store, "merge_counts",
                        lambda path, rows, *rest: (seen.append(plan(rows)), merge(path, rows, *rest)))
    queries.expired_counts(spark, small)
    assert len(seen) == 2 and not any("regexp_extract_all" in p for p in seen)


def test_ingest_writes_posts_by_date_in_a_dense_codec(spark, tmp_path):
    lexicon = spark.createDataFrame([("alpha", 0.5, 0.0)],
                                    "word string, positive double, negative double")
    job = Ingest(str(tmp_path), lexicon, rebalance=True, enrich=PLAIN)
    for _ in range(2):
        job.run(records(spark).repartition(6), 0)
    files = list(Path(job.posts).rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert len(files) <= 3 * 2  # not one for each task and date
    assert job.read_posts(spark).count() == job.read_tokens(spark).count() == 40
    assert job.read_posts(spark).filter("sentiment = 1").count() == 40
    assert {r[0] for r in job.read_posts(spark).select("postedDate").distinct().collect()} == {
        "2024-01-01", "2024-01-02", "2024-01-03"}


def test_windows_tokenize_in_all_tasks(spark):
    one_file = records(spark).coalesce(1)
    found = windowed_entity_counts(one_file, **PLAIN)
    assert f"{spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan(found)
    assert found.filter("term = 'alpha'").agg(F.sum("count")).first()[0] == 40


def test_steps_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=20)

    def step(n):
        both.wait()
        return spark.range(n)

    assert [df.count() for df in at_once(spark, lambda: step(2), lambda: step(3))] == [2, 3]
