"""The append-only event log: (event_id, topic, payload JSON, session_id, created_at ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, topic string, payload string, session_id string, created_at long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def poll(events: DataFrame, topics: list[str], offset: int, batch: int = 10) -> DataFrame:
    """The next ``batch`` events of ``topics`` after ``offset``."""
    return events.where(F.col("topic").isin(topics) & (F.col("event_id") > offset)).orderBy("event_id").limit(batch)


def offsets(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(view, last_event_id): the last event of each view's topics."""
    last = events.groupBy("topic").agg(F.max("event_id").alias("last"))
    return subscriptions.join(last, "topic", "left").groupBy("view").agg(F.max("last").alias("last_event_id"))


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
