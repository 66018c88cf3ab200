"""Joins and windows over time: as-of, interval, sessions, hopping windows, and rows that come late.

A key may hold a third of all rows and a span may be of any length, so nothing here is
windowed by key alone: ordered work is dealt into ranges of (key, time) with a carried
value for each range, and spans are cut into bins that grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.operators import ranges


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """All rows of ``left`` with ``values`` of the last row of ``right`` of the same key at or before their time.

    Both sides have ``key`` and ``at``; of rows of ``right`` with one key and time the one
    with the largest values counts. Rows without a time or key, and those before the first, get nulls.

    Both sides are one ordered stream, dealt into ranges of (key, time, side), so a hot key
    takes many of them. Each range carries the last value along its rows; what a range begins
    with is the last value that the ranges before it leave for its key. No name of ``left`` is taken by ``values``.
    """
    value = F.struct(*values)
    least = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(at).alias("_at")).agg(F.max(value).alias("_value"))
    rest = F.struct(*left.columns)
    told = least.select("_key", "_at", F.lit(0).alias("_side"), "_value", F.lit(None).cast(left.select(rest.alias("r")).schema["r"].dataType).alias("_row"))
    asked = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(told.schema["_value"].dataType).alias("_value"), rest.alias("_row"))
    dealt = ranges.dealt(told.unionByName(asked), ["_key", "_at", "_side"])
    along = Window.partitionBy("_range", "_key").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    within = dealt.withColumn("_held", F.last("_value", ignorenulls=True).over(along)).where("_side = 1")
    left_by = dealt.where("_side = 0").groupBy("_range", "_key").agg(F.max_by("_value", "_seq").alias("_left"))
    heads = dealt.select("_range", "_key").distinct().join(left_by, ["_range", "_key"], "left")
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    heads = heads.select("_range", "_key", F.last("_left", ignorenulls=True).over(before).alias("_before"))
    joined = within.join(heads, ["_range", "_key"], "left")
    # Rows without a time stand first in their key, so nothing is carried to them.
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_held", "_before"))
    return joined.select("_row.*", *(found[v].alias(v) for v in values))


def _micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970, without a time zone where the column has none."""
    if df.schema[c].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(c)


def within(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a span that holds it: ``begin`` <= ``at`` < ``end``, and equal ``keys`` if any.

    A span lies in one or two bins of its own size class (the power of two of
    microseconds that is no shorter), a point in one bin of each class that occurs; they
    meet in bins, and the edges are then checked exactly. So a long span isn't cut into many
    pieces, a short one doesn't meet points far off, and there is no width to choose. Empty
    spans and nulls match nothing.
    """
    some = spans.where(F.col(begin) < F.col(end))
    first, last = _micros(spans, begin), _micros(spans, end) - 1
    some = some.withColumn("_class", F.greatest(F.lit(0), F.ceil(F.log2((last - first + 1).cast("double")))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("_class"))
    met = some.withColumn("_bin", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    classes = some.agg(F.collect_set("_class").alias("_classes"))  # 63 numbers at most
    dealt = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(classes)).withColumn("_class", F.explode("_classes")).drop("_classes")
    dealt = dealt.withColumn("_bin", F.floor(_micros(points, at) / width))
    return dealt.join(met, ["_class", "_bin", *(keys or [])]).where((F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_class", "_bin")


def held_totals(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, id_: str) -> DataFrame:
    """``begin``, ``end``, ``n``, ``earliest`` and ``total`` (of the whole numbers ``id_``) of the points that each distinct span holds.

    The same as totals over the pairs of ``within``, without any pair: points and edges of spans are one ordered
    stream, dealt into ranges with running totals, and a span's totals are those at its end less those at its
    beginning. Spans that hold nothing are left out. Time grows with points and spans and not with what they share.
    """
    some = spans.where(F.col(begin) < F.col(end)).select(F.col(begin).alias("_begin"), F.col(end).alias("_end")).distinct()
    known = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.sum(id_).alias("_sum"))
    edges = some.select(F.explode(F.array("_begin", "_end")).alias("_at")).distinct()  # an edge stands before the points of its time
    stream = edges.select("_at", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), F.lit(None).cast("long").alias("_sum"))
    dealt = ranges.dealt(stream.unionByName(known.select("_at", F.lit(1).alias("_side"), "_n", "_sum")), ["_at", "_side"])
    point = F.when(F.col("_side") == 1, F.col("_at"))
    shares = dealt.groupBy("_range").agg(F.sum("_n").alias("_rn"), F.sum("_sum").alias("_rsum"), F.min(point).alias("_rat"))
    by = Window.orderBy("_range")  # a row for each range
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    carried = shares.select("_range", F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_rsum").over(before), F.lit(0)).alias("_bsum"), F.min("_rat").over(after).alias("_later"))
    along = Window.partitionBy("_range").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_range").orderBy(F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.select("_range", "_side", "_at", F.sum("_n").over(along).alias("_n"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_sum"), F.min(point).over(back).alias("_next"))
    marks = told.where("_side = 0").join(F.broadcast(carried), "_range").select("_at", (F.col("_n") + F.col("_bn")).alias("_n"), (F.col("_sum") + F.col("_bsum")).alias("_sum"), F.coalesce("_next", "_later").alias("_next"))
    named = lambda p: marks.select(*(F.col(c).alias(p + c) for c in marks.columns))
    both = some.join(named("b"), F.col("_begin") == F.col("b_at")).join(named("e"), F.col("_end") == F.col("e_at")).where(F.col("e_n") > F.col("b_n"))
    return both.select(F.col("_begin").alias(begin), F.col("_end").alias(end), (F.col("e_n") - F.col("b_n")).alias("n"), F.col("b_next").alias("earliest"), (F.col("e_sum") - F.col("b_sum")).alias("total"))


def watermarked(rows: DataFrame, at: str, batch: str, delay: str, lag: int = 1) -> DataFrame:
    """Rows with ``watermark``: the latest time of all batches that are ``lag`` or more before theirs, less ``delay``.

    A stream that pauses between batches drops late rows by the batches before (1); one that
    always finds a next batch waiting is a batch behind with that (2).
    """
    highs = rows.groupBy(batch).agg(F.max(at).alias("_high"))  # a row for each batch
    earlier = F.max("_high").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -lag))
    marks = highs.select(batch, (earlier - F.expr(f"INTERVAL {delay}")).alias("watermark"))
    return rows.join(marks, batch)


def _in_time(rows: DataFrame, end: Column, batch: str | None, at: str, delay: str | None, lag: int) -> DataFrame:
    if batch is None or delay is None:
        return rows.withColumn("late", F.lit(False))
    return watermarked(rows, at, batch, delay, lag).withColumn("late", F.coalesce(end <= F.col("watermark"), F.lit(False))).drop("watermark")


def late_for_sessions(rows: DataFrame, at: str, gap: str, batch: str, delay: str, lag: int = 1) -> DataFrame:
    """Rows that come when a session of theirs alone would have been closed: the side output of ``sessions``."""
    return _in_time(rows, F.col(at) + F.expr(f"INTERVAL {gap}"), batch, at, delay, lag).where("late").drop("late")


def sessions(rows: DataFrame, key: str, at: str, gap: str, batch: str | None = None, delay: str | None = None, lag: int = 1) -> DataFrame:
    """``key``, ``begin``, ``end`` (last time and the gap), ``n``: runs of rows less than ``gap`` apart; late rows are left out."""
    kept = _in_time(rows, F.col(at) + F.expr(f"INTERVAL {gap}"), batch, at, delay, lag).where(~F.col("late") & F.col(at).isNotNull())
    counted = kept.groupBy(F.col(key), F.session_window(F.col(at), gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")


def hopping(rows: DataFrame, key: str, at: str, length: str, step: str, batch: str | None = None, delay: str | None = None, lag: int = 1) -> DataFrame:
    """``key``, ``begin``, ``n`` and ``late``: rows of windows of ``length`` that begin every ``step``, and those that came after the window was closed."""
    placed = rows.where(F.col(at).isNotNull()).withColumn("_w", F.window(F.col(at), length, step))
    told = _in_time(placed, F.col("_w.end"), batch, at, delay, lag)
    return told.groupBy(F.col(key), F.col("_w.start").alias("begin")).agg(F.count_if(~F.col("late")).alias("n"), F.count_if("late").alias("late"))


def levels(df: DataFrame, by: list[str], measures: list[Column], drill: bool = False) -> DataFrame:
    """Measures at every combination of ``by`` in one pass, or with ``drill`` at every beginning of the list.

    ``level`` has a bit for each column that is summed over, the first column's the highest;
    a null of the data keeps apart from one that stands for all. Each row goes into a partial sum for each level
    before anything is shuffled.
    """
    grouped = df.rollup(*by) if drill else df.cube(*by)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *measures)
