"""File sources and sinks of the store: blobs by prefix, raw files, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOBS = "cid string, bytes binary, size long, created_at long"


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Append blobs, partitioned by the first two characters of the hash part of their id."""
    blobs.withColumn("prefix", F.substring("cid", -2, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def read_blobs(spark: SparkSession, path: str, cids: list[str] | None = None) -> DataFrame:
    """The blob table, or some of it (only their partitions are read)."""
    out = spark.read.schema(f"{BLOBS}, prefix string").parquet(path)
    if cids is not None:
        out = out.where(F.col("prefix").isin(sorted({c[-2:] for c in cids})) & F.col("cid").isin(cids))
    return out.drop("prefix")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files stored under <id 0-2>/<id 2-4>/<rest>, with their ids.  Spark's scan passes over empty files."""
    parts = F.regexp_extract("path", r"([^/]{2})/([^/]{2})/([^/]+)$", 0)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace(parts, "/", "").alias("cid"), F.col("content").alias("bytes"), F.col("length").alias("size"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines of JSON-lines files, without blank ones."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("line")).where("line <> ''")


def write_lines(messages: DataFrame, path: str) -> None:
    """Messages (position, role, content) as JSON lines in order; the commit replaces what was there."""
    messages.orderBy("position").select(F.to_json(F.struct("role", "content")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
