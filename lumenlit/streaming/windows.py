"""Sessions of a stream, and the rows that come too late for them.

The results are those of ``operators.temporal`` over the same batches, with a ``lag`` of 2
where the next batch is always waiting, as when files that are there already are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_stream(rows: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """``key``, ``begin``, ``end``, ``n`` of each session, once the watermark has passed its end (append)."""
    timed = rows.withWatermark(at, delay).groupBy(F.col(key), F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return timed.select(key, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")


def hopping_stream(rows: DataFrame, key: str, at: str, length: str, step: str, delay: str) -> DataFrame:
    """``key``, ``begin``, ``n`` of each window, once the watermark has passed its end (append)."""
    timed = rows.withWatermark(at, delay).groupBy(F.col(key), F.window(at, length, step).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return timed.select(key, F.col("_w.start").alias("begin"), "n")


def keep_late(rows: DataFrame, at: str, gap: str, delay: str, folder: str, checkpoint: str, lag: int = 2) -> StreamingQuery:
    """Write the rows that ``session_stream`` drops to ``folder/late``, by batch.

    Each batch's latest time goes to ``folder/marks``, from which the next ones take their
    watermark; a batch that runs again after a restart overwrites what it wrote.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.createDataFrame([], "high timestamp, batch long")
        if number >= lag:
            seen = spark.read.schema("high timestamp, batch long").parquet(f"{folder}/marks")
        mark = seen.where(F.col("batch") <= number - lag).agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
        late = batch.crossJoin(F.broadcast(mark)).where(F.col(at) + F.expr(f"INTERVAL {gap}") <= F.col("_mark")).drop("_mark")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.agg(F.max(F.col(at).cast("timestamp")).alias("high")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
