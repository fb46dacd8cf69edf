"""The pipeline's stages on null, repeated and clashing ids, and end to end."""

import corpus_pipeline as pipeline
from murmura.runtime import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=40):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def written(spark, rows, files=1):
    path = scratch_path(spark, "rows")
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(files).write.parquet(path)
    return spark.read.parquet(path)


def test_one_row_of_each_group_of_copies_stays(spark):
    t, u, v = words("t"), words("u"), words("v")
    rows = [(5, t), (5, t), (7, u), (6, t), (6, v), (None, t), (None, t), (None, words("n")), (8, None), (9, ""),
            (3, t + " more")]
    kept = pipeline.ngram_jaccard_join(spark, written(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(3, t + " more"), (7, u), (6, v), (None, words("n")), (8, None), (9, "")], key=str)
    assert pipeline.ngram_jaccard_join(spark, written(spark, []), "").count() == 0


def test_rows_of_several_files_keep_their_numbers(spark):
    rows = pipeline.numbered(written(spark, [(i % 3, words(i)) for i in range(50)], files=4))
    first = {(r.doc_id, r.text): r.row for r in rows.collect()}
    assert len(set(first.values())) == 50
    assert first == {(r.doc_id, r.text): r.row for r in rows.select("row", "text", "doc_id").collect()}


def test_whole_pipeline_packs_what_the_stages_keep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, left, small).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == pipeline.COLUMNS
    pieces = pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in left.select("doc_id").collect()}
    totals = {}
    for r in pieces:
        assert len(r.ids) == r.length
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)
