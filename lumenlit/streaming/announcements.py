"""Announcements as a stream: an extension with event time and state.

Files of announcements arrive in a folder; repeats within the watermark are dropped by
identifier and each micro-batch is merged into a versioned history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlit.operators.state import replay

SCHEMA = "arxiv_id string, at timestamp, score double, report long, analyzed boolean, summary string, announce_type string"


def announcements(spark: SparkSession, folder: str, types: tuple[str, ...] = ("new", "cross"), late: str = "2 days") -> DataFrame:
    """The stream of first announcements; repeats that come within ``late`` are dropped."""
    rows = spark.readStream.schema(SCHEMA).json(folder).where(F.col("announce_type").isin(*types))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["arxiv_id"])


def daily_counts(rows: DataFrame) -> DataFrame:
    """Announcements of each day and type, complete once the watermark has passed."""
    return rows.groupBy(F.window("at", "1 day").alias("day"), "announce_type").agg(F.count(F.lit(1)).alias("n"))


def keep_history(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's events under its number, so a batch that runs again overwrites itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, folder: str) -> DataFrame:
    return replay(spark.read.parquet(folder))
