"""A history as versions in buckets, so that a batch is merged into it by shuffling the batch alone.

Every version is a folder of Parquet files in a fixed number of buckets by identifier, each
sorted. Merging reads bucket by bucket, deals the batch out to the same buckets and writes the
next version in them; the old rows never cross the network. A version isn't changed once
it is written, so a run that fails leaves the one before it as it was.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenlit.operators.state import upsert_history

#: Buckets of a history; below the session's number of shuffle partitions Spark would deal out both sides.
BUCKETS = 256
KEY = "arxiv_id"


def _name(folder: str, version: int) -> str:
    return "history_" + re.sub(r"\W+", "_", folder)[-80:].strip("_").lower() + f"_{version}"


def saved(history: DataFrame, folder: str, version: int, buckets: int = BUCKETS) -> DataFrame:
    """Write a history as a version of a folder that all executors share, and give it as read from there."""
    name = _name(folder, version)
    spark = history.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    history.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{folder}/version={version}").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def version(spark: SparkSession, folder: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """A version that was written before, by this session or another one, with its buckets."""
    name = _name(folder, number)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(f"{folder}/version={number}").schema
        told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        spark.sql(f"CREATE TABLE {name} ({told}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{folder}/version={number}'")
    return spark.table(name)


def upserted(spark: SparkSession, folder: str, number: int, batch: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A version with a batch merged into it, as ``state.upsert_history`` has it; ``saved`` makes it the next one."""
    return upsert_history(version(spark, folder, number, buckets), batch)
