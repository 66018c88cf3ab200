"""Ranking, top-k and budget operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_order(position: str = "id") -> list[Column]:
    """Score, relevance, citations (absent as 0), then arrival."""
    return [F.desc("score"), F.desc("relevance"), F.desc(F.coalesce(F.col("citations"), F.lit(0))), F.asc(position)]


def top_n(df: DataFrame, n: int, position: str = "id") -> DataFrame:
    return df.orderBy(*rank_order(position)).limit(n)


def rest_of(df: DataFrame, chosen: DataFrame, key: str = "id", n: int = 15) -> DataFrame:
    """What wasn't chosen, most relevant first."""
    return df.join(chosen.select(key), key, "left_anti").orderBy(F.desc("relevance"), key).limit(n)


def relevance_floor(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("relevance") >= least) if least > 0 else df


def budget(cap: int, queries: int, per_query: int, floor: int, spread: float = 1.35) -> int:
    """Rows that each of several queries may bring."""
    return max(floor, min(per_query, -int(-cap * spread // max(1, queries))))


def per_group_limit(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def prefix_within(df: DataFrame, group: str | None, order: list, size: Column, limit: int) -> DataFrame:
    """Rows from the start of each group while sizes plus one for each parting fit; one row at least.

    Every row takes one at least, so no more than ``limit`` + 1 rows of a group can be
    looked at; each task brings its own first ones, and only those meet for the sums.
    """
    keys = [group] if group else [F.lit(1)]
    if group:
        few = per_group_limit(df, group, order, limit + 1)
    else:
        few = df.orderBy(*order).limit(limit + 1)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    # Sums only grow, so the first row that overflows is followed by none that fits.
    return few.withColumn("_start", start).where((F.col("_start") == 0) | (F.col("_start") + size <= limit)).drop("_start")


def most_relevant(df: DataFrame, n: int, by: str = "relevance", position: str = "id") -> DataFrame:
    """The ``n`` rows that are worth a dear step (a judge, a look-up), best first; all of them if there are no more."""
    return df.orderBy(F.desc(by), position).limit(n)


def removed_list(removed: DataFrame, order: str, n: int = 60) -> DataFrame:
    """The first ``n`` removed rows with ``more``: how many others there are."""
    total = removed.agg(F.count(F.lit(1)).alias("_all"))
    return removed.orderBy(order).limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")


def transcript(turns: DataFrame, conversation: str, order: str, text: str, last: int = 12, limit: int = 9000) -> DataFrame:
    """The newest turns of each conversation: the last ``last`` that aren't blank, newest first within the budget."""
    newest = per_group_limit(turns, conversation, [F.desc(order)], last).where(F.trim(text) != "")
    return prefix_within(newest, conversation, [F.desc(order)], F.length(text), limit)


def undo_last_turn(turns: DataFrame, conversation: str, order: str, role: str = "role") -> DataFrame:
    """What is left before the last question of each conversation."""
    asked = F.max(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(conversation))
    return turns.withColumn("_asked", asked).where(F.col("_asked").isNull() | (F.col(order) < F.col("_asked"))).drop("_asked")


def batches(df: DataFrame, order: list, size: int) -> DataFrame:
    """``batch`` and ``place`` of fixed-size chunks of a small ordered result."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(n / size).cast("int")).withColumn("place", F.pmod(n, F.lit(size)))
