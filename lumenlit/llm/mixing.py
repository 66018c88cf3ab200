"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed for each source, water is filled by weight up to a largest repetition
rate, and each document is taken floor(rate) times plus one hash-seeded Bernoulli copy
with the fraction as its probability. The hash is md5 of the seed and the id, so a rerun
takes the same copies, and SQL can say the same.

Only the table of sources (a row each) is ranked and joined; a hot source costs nothing,
as its rows are summed before the shuffle and no row moves to meet its source's rate (up
to a checked number of sources; beyond it, a salted join). Null sources are one source, last in order;
null texts have size 0; sources of size 0 get target and rate 0; repeated rows are taken
alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.llm.common import WORD, persisted, unused

MAX_RATE = 3.0
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: A table of sources with no more rows than this is broadcast (about 60 bytes a row); beyond it the join is salted.
BROADCAST_SOURCES = 50_000
SALTS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each source: ``_source``, ``source_size``, ``target``, ``rate``.

    Sources sorted by how much they can take for their weight are capped one after
    another until the level that the rest share lies below what each can take.
    """
    sums = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sums.withColumn("_w", weight.cast("double")).withColumn("_ratio", F.lit(max_rate) * F.col("source_size") / F.col("_w"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.lit(max_rate) * F.col("source_size")).over(earlier), F.lit(0.0))
    level = left / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
    levels = ranked.withColumn("_level", level).withColumn("_capped", F.col("_ratio") <= F.col("_level"))
    rest = F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_source", "_level"))).over(all_rows)["_level"]
    target = F.when(F.col("_capped"), F.lit(max_rate) * F.col("source_size")).otherwise(F.col("_w") * rest)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(max_rate), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return levels.withColumn("target", target).select("_source", "source_size", "target", rate.alias("rate"))


def mix(df: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """All rows with ``source_size``, ``target``, ``rate`` and ``copies`` int (0 to ``max_rate``).

    Columns of the input with those names are replaced.
    """
    df = df.drop("source_size", "target", "rate", "copies")
    name, salt, own = unused(df, "named", "salt", "own")
    targets = persisted(source_targets(df.select(source, size), source, size, weights, max_rate).withColumnRenamed("_source", name))
    if targets.count() <= BROADCAST_SOURCES:
        joined = df.join(F.broadcast(targets), F.col(source).eqNullSafe(F.col(name))).drop(name)
    else:
        # A hot source's rows are dealt over SALTS tasks, and each source is there once for each.
        salted = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = df.withColumn(own, F.pmod(F.xxhash64(doc_id, size), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col(source).eqNullSafe(F.col(name)) & (F.col(own) == F.col(salt))).drop(name, own, salt)
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (draw(F.col(doc_id), seed) < F.col("rate") - whole).cast("long")).cast("int"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as many times as ``copies`` says; ``copy`` counts them from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
