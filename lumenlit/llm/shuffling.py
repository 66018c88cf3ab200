"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of
their key; pass two gives each bucket to one task, puts it in a fixed order and
Fisher-Yates shuffles it (Spark's seeded ``shuffle``, whose stream is the seed plus the
number of the partition, here the number of the bucket). The buckets one after another
are a uniform permutation of the table. Without crowded keys it depends on the records
and the seed only; a task that runs again on another executor gives the same rows.

Keys that many rows share (nulls, repeated rows) are found by a count and spread over
all buckets by the place of the row in the input, so where these rows go depends on how
the input is laid out in files as well. Columns must be orderable. An empty
table gives an empty one; rows that are equal stay as many as they are; other columns may
have any names. A bucket is a task: at 100 TB raise ``bucket_bytes`` to what a task can
sort (1 GB makes 100,000 of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.llm.common import unused

#: Bytes of records in a bucket, on average.
BUCKET_BYTES = 16 << 20
#: A table of bucket offsets with no more rows than this is broadcast (24 bytes a row).
BROADCAST_ROWS = 100_000


def external_shuffle(df: DataFrame, key: str, size: str, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows with ``bucket`` int, ``place`` long (in the bucket) and ``position`` long (in the whole).

    ``key`` names the column whose seeded hash scatters the rows, ``size`` the one that
    holds a row's bytes. Columns of the input that have the three names are replaced.
    """
    df = df.drop("bucket", "place", "position")
    total = df.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    crowd = max(1000, -(-total["rows"] // (4 * buckets)))
    # At most four crowded keys for each bucket exist, so their list is bounded by the number of buckets.
    hot, flag, hashed = unused(df, "key", "crowded", "h")
    crowded = df.groupBy(F.col(key).alias(hot)).agg(F.count(F.lit(1)).alias(flag)).where(F.col(flag) > crowd).select(hot, F.lit(True).alias(flag))
    few = 4 * buckets <= BROADCAST_ROWS
    scattered = df.join(F.broadcast(crowded) if few else crowded, F.col(key).eqNullSafe(F.col(hot)), "left")
    salt = F.when(F.col(flag), F.monotonically_increasing_id())
    h = F.xxhash64(F.lit(seed), F.col(key), salt)
    names = df.columns
    scattered = scattered.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.struct(F.xxhash64(F.lit(seed + 1), F.col(key)).alias(hashed), *(F.col(c) for c in names)).alias("record"))
    shuffled = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.shuffle(F.array_sort(F.collect_list("record")), F.lit(seed)).alias("records"))
    )
    counts = scattered.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("_bucket"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = shuffled.join(F.broadcast(offsets) if buckets <= BROADCAST_ROWS else offsets, F.col("bucket") == F.col("_bucket"))
    return placed.select("bucket", "_before", F.posexplode("records").alias("_place", "_record")).select(
        *(F.col("_record")[c].alias(c) for c in names), "bucket", F.col("_place").cast("long").alias("place"), (F.col("_before") + F.col("_place")).alias("position")
    )


def shards(shuffled: DataFrame, n_shards: int) -> DataFrame:
    """Deal the permutation out: ``shard`` int and ``slot`` long; counts are at most one apart."""
    return shuffled.withColumns({"shard": F.pmod("position", F.lit(n_shards)).cast("int"), "slot": F.floor(F.col("position") / n_shards)})


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its records in slot order; each task writes a range of one shard, or of two."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
