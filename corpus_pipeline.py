"""A training-corpus pipeline over ``documents``: each stage applies one operator to all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm import quality_classifier as classifier
from murmura.llm import quality_rules as rules
from murmura.llm.common import table
from murmura.llm.ngram_jaccard import link_components
from murmura.llm.packing import pack_documents
from murmura.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, model).filter("kept").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    labels = table(spark, sf_dir, "labels")
    return rules.judge(docs, labels, carry=COLUMNS).filter("kept").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """Documents of a written table with ``row``, a number that stays the same at every reading.

    It is made of the place of the row's file in the order of names, one row per file, and of the
    row's place there.
    """
    named = docs.select("*", "_metadata.file_path", "_metadata.row_index")
    files = named.select("file_path").distinct().withColumn(
        "file", F.row_number().over(Window.orderBy("file_path")).cast("long"))
    return named.join(F.broadcast(files), "file_path").select(
        *COLUMNS, (F.shiftleft("file", 40) + F.col("row_index")).alias("row"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, and all others.

    Rows are told apart by their place, so of rows that repeat a doc_id and a text one stays, equal
    doc_ids with unlike texts are two documents, and a null doc_id comes after all others.
    """
    rows = numbered(docs)
    found = link_components(rows.select(F.col("row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = (rows.select("row", "doc_id").join(found, "row").groupBy("component_id")
            .agg(F.min(first).alias("first")).select("first.row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's ids in sequences of at most 4096 tokens."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("packing", packing),
]
ORACLE_SQL = None
"""The classifier is trained, and tokens come from a library: no SQL gives these rows."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
