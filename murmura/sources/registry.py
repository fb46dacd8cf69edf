"""Model registry and membership cache as small append-only tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MODELS = "date string, path string, created_at timestamp"


def save_model(model: Word2VecModel, folder: str, date: str, created_at: datetime,
               spark: SparkSession | None = None) -> str:
    """Save a model and announce it; returns the model's path."""
    spark = spark or SparkSession.active()
    path = f"{folder}/models/{date}"
    model.write().overwrite().save(path)
    row = spark.createDataFrame([(date, path, created_at)], _MODELS)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/registry")
    return path


def latest_model(spark: SparkSession, folder: str, before: datetime | None = None) -> DataFrame:
    """The newest registry row, optionally as of a time."""
    rows = spark.read.schema(_MODELS).parquet(f"{folder}/registry")
    if before:
        rows = rows.filter(F.col("created_at") <= F.lit(before))
    return rows.orderBy(F.col("created_at").desc(), F.col("date").desc()).limit(1)


def load_latest(spark: SparkSession, folder: str) -> tuple[str, Word2VecModel] | None:
    row = latest_model(spark, folder).first()
    return (row.date, Word2VecModel.load(row.path)) if row else None


def save_membership(root: str, key: str, labels: DataFrame, created_at: datetime) -> None:
    """Replace the members stored for a query key."""
    (labels.select(F.col("id").alias("uid"), "community", F.lit(created_at).alias("created_at"))
     .write.mode("overwrite").parquet(f"{root}/query_key={key}"))


def read_membership(spark: SparkSession, root: str, key: str, now: datetime,
                    seconds: int = 600) -> DataFrame:
    """Members stored for a key, none once they are older than ``seconds``."""
    fresh = F.col("created_at") >= F.lit(now - timedelta(seconds=seconds))
    return (spark.read.parquet(root).filter((F.col("query_key") == key) & fresh)
            .select("uid", "community"))
