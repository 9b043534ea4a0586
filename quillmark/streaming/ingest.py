"""Catalogue ingestion as a stream: new JSON Lines files, one row per question id, gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.catalogue_files import QUESTION


def catalogue_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Valid records of the catalogue files as they come, with their file's time."""
    rows = spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", max_files).json(path)
    return rows.withColumn("seen_at", F.col("_metadata.file_modification_time")).filter("question_id is not null and coalesce(is_valid, true)")


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first record of each question id; state is dropped once the watermark has passed it."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["question_id"])


def gap_sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Rows per session: a new one begins where the gap is passed without a row."""
    return stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def append_catalogue(stream: DataFrame, path: str, checkpoint: str):
    """Appends the stream to a catalogue, exactly once per batch."""
    return stream.drop("seen_at").writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
