"""Places of rows within their groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.llm.common import stored, unused


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``position`` (from 0 by ``order``, nulls first) and ``members`` (rows of the group).

    Rows are dealt into ranges of (group, order), so a large group takes many of them and no
    window holds it; each range numbers its rows, and a range's share of a group begins
    where the ranges before it end. Only rows alike in the group and all of ``order`` are
    interchangeable. The ranges are a stored table, so a lost executor doesn't deal them anew.
    """
    seq, part, first, before = unused(df, "_seq", "_part", "_first", "_before")
    keys = [group, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(seq, F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn(part, F.shiftright(seq, 33)))
    shares = dealt.groupBy(F.col(group).alias("_group"), part).agg(F.min(seq).alias(first), F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("_group")  # a row for each range at most
    earlier = F.sum("_n").over(by.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select("_group", F.col(part).alias("_of"), first, F.coalesce(earlier, F.lit(0)).alias(before), F.sum("_n").over(by).alias("members"))
    placed = dealt.join(shares, F.col(group).eqNullSafe(F.col("_group")) & (F.col(part) == F.col("_of")))
    return placed.withColumn("position", F.col(before) + F.col(seq) - F.col(first)).select(*df.columns, "position", "members")
