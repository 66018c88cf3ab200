"""Numbers of ordered rows, where one group, or the whole table, may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.operators.graph import shared_folder


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ranges of their order, with ``_seq`` (their place, rising from range to range) and ``_range``.

    Kept by a reliable checkpoint, so a lost executor doesn't deal them anew.
    """
    shared_folder(df)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    return ranged.withColumn("_range", F.shiftright("_seq", 33)).checkpoint()


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``number``, from 1 in each group by ``order`` (nulls first; rows alike in it are interchangeable).

    Ranges number their rows side by side, and a range's share of a group begins where the ranges before it
    end; so neither a hot group nor a table without groups is sorted in one task.
    """
    rows = dealt(df, [*group, *order])
    shares = rows.groupBy("_range", *group).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shares = shares.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnsRenamed({c: f"_of_{c}" for c in ["_range", *group]})
    same: Column = F.col("_range") == F.col("_of__range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    placed = rows.join(shares, same)
    return placed.withColumn("number", F.col("_before") + F.col("_seq") - F.col("_first") + 1).select(*df.columns, "number")
