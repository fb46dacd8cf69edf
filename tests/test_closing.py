"""Closed windows, timers of counter groups, and merging of small batch folders."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmura.plans.ingest import own_batch
from murmura.runtime import scratch_path
from murmura.sources import counter_store as store
from murmura.sources import tables
from murmura.streaming import closing


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "postedDate string, kind string, term string, count long")


def test_late_counts_beside_those_in_time(spark):
    everything = counts_of(spark, [("2024-01-01", "#", "#a", 5), ("2024-01-01", "#", "#b", 2),
                                   ("2024-01-02", "@", "@c", 1), ("2024-01-03", "#", "#a", 9)])
    closed = counts_of(spark, [("2024-01-01", "#", "#a", 3), ("2024-01-02", "@", "@c", 1)])
    got = {tuple(r) for r in closing.late_counts(everything, closed).collect()}
    # Day 3 is still open; #b came only after day 1 was closed.
    assert got == {("2024-01-01", "#", "#a", 3, 2), ("2024-01-01", "#", "#b", 0, 2),
                   ("2024-01-02", "@", "@c", 1, 0)}


def test_late_counts_before_any_day_is_closed(spark):
    everything = counts_of(spark, [("2024-01-01", "#", "#a", 5)])
    assert closing.late_counts(everything, counts_of(spark, [])).isEmpty()


def test_newest_update_per_group_within_a_batch(spark):
    import pyarrow as pa
    rows = [{"postedDate": "d", "kind": "#", "updated_at": datetime(2024, 1, i % 5 + 1)}
            for i in range(1000)] + [{"postedDate": None, "kind": "@",
                                      "updated_at": datetime(2024, 1, 9)}]
    batch = pa.RecordBatch.from_pylist(rows)
    got = pa.Table.from_batches(closing._newest_per_group(iter([batch]))).to_pylist()
    assert sorted(got, key=str) == sorted([
        {"postedDate": "d", "kind": "#", "updated_at": datetime(2024, 1, 5)},
        {"postedDate": None, "kind": "@", "updated_at": datetime(2024, 1, 9)}], key=str)


def test_state_holds_one_row_per_living_group(spark):
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    held = []
    for day in range(0, 30, 5):
        when = datetime(2024, 1, 1) + timedelta(days=day)
        rows = [(f"{when:%Y-%m-%d}", "#", f"#t{i}", 1) for i in range(50)]
        store.merge_counts(path, counts_of(spark, rows), day, when)
        query = closing.start_expiry(spark, path, checkpoint, interval=None)
        query.awaitTermination()
        # One time and one timer (kept by key and by time) for each group alive.
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 3 * 3
    left = {r[0] for r in store.read_counts(spark, path).select("postedDate").distinct().collect()}
    assert left == {"2024-01-21", "2024-01-26"}
    folders = [f for f in os.listdir(f"{path}/batches") if f.startswith("batch_id=")]
    assert len(folders) <= 2


def test_updates_without_a_time_and_an_empty_batch_are_passed_over(spark):
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    store.merge_counts(path, counts_of(spark, [("2024-01-01", "#", "#a", 1)]), 0, None)
    store.merge_counts(path, counts_of(spark, []), 1, datetime(2024, 3, 1))
    closing.start_expiry(spark, path, checkpoint, interval=None).awaitTermination()
    assert store.read_counts(spark, path).count() == 1


def test_many_batches_become_few_files_and_count_once(spark):
    root = scratch_path(spark, "posts")

    def batch(i):
        return spark.createDataFrame([(f"p{i}", f"2024-01-0{i % 2 + 1}")],
                                     "post_id string, postedDate string").coalesce(1)

    for i in range(200):
        tables.write_batch(batch(i), root, i)
    tables.write_batch(batch(777), root, own_batch("backfill", "a b"))

    def ids():
        return sorted(r[0] for r in tables.read_table(spark, root).select("post_id").collect())

    want = sorted([f"p{i}" for i in range(200)] + ["p777"])
    assert ids() == want
    assert tables.compact_table(spark, root, 99) == []
    assert ids() == want
    deleted = tables.compact_table(spark, root, 198, remove=True)
    assert len(deleted) == 199
    tables.write_batch(batch(7), root, 7)  # a replay after the merge
    assert ids() == want
    assert len(tables.read_table(spark, root).inputFiles()) <= 6
    # A merge that did not end is not read, and is replaced when run again.
    tables.write_batch(batch(5), f"{root}_merged", 0)
    os.makedirs(f"{root}_merged/upto=500", exist_ok=True)
    assert ids() == want
    day = tables.read_day(spark, root, "2024-01-01")
    assert day.count() == 100 and dict(day.dtypes)["batch_id"] == "bigint"


def test_a_table_all_of_whose_batches_are_merged(spark):
    root = scratch_path(spark, "posts")
    one = spark.createDataFrame([("p", "2024-01-01")], "post_id string, postedDate string")
    tables.write_batch(one, root, 0)
    tables.compact_table(spark, root, 0, remove=True)
    assert tables.read_table(spark, root).filter(F.col("batch_id") == 0).count() == 1
    assert tables.compact_table(spark, root, 0, remove=True) == []


def test_numbers_made_from_paths_never_meet_the_streams():
    a, b = own_batch("backfill", "x y"), own_batch("on demand", ["x", "y"])
    assert a < 0 and b < 0 and a != b
    assert own_batch("backfill", "y  x") == a and -2 ** 63 <= a


def test_late_events_keep_no_table_of_all_records(spark, tmp_path, monkeypatch):
    from murmura.catalog import words

    kept = []
    monkeypatch.setattr(words, "materialize", lambda df, label: kept.append(label) or df)
    spark.range(56).selectExpr(
        "id AS event_id", "timestamp'2024-01-09 10:00:00' + make_interval(0, 0, 0, 10) * "
        "CAST(id >= 28 AS INT) AS ts", "id % 4 AS user_id", "'error' AS event_type",
        "1.0D AS value", """'{"k": 1}' AS props""").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 0L AS doc_id, 'some' AS text, 'en' AS lang").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = {(r.postedDate, r.term): (r["count"], r.late)
             for r in words.late_events(spark, str(tmp_path)).collect()}
    assert not kept
    assert found == {("2024-01-09", t): (24, 4) for t in ("#error", "#t1", "some")}
