"""Reading tables so that the work spreads over the cluster, and letting its Python workers import this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was loaded from."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def spread(df: DataFrame) -> DataFrame:
    """The table in at least as many partitions as there are cores.

    A small table in one file would be read, and its text worked on, by one task; a table
    of many files comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
