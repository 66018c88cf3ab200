"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps, each a grouping and a join, until the edges
stop changing; every round is checkpointed in the shared folder, so a lost executor costs
one round. No neighbourhood is ever collected: a hub's smallest neighbour is an aggregate,
and its edges are rewritten row by row in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> None:
    """Checkpoints go to the folder the cluster names; a session on one machine may put them beside the warehouse."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for nodes other than their root.

    Nulls and loops are ignored; repeated edges count once; no edges give no rows.
    """
    shared_folder(edges)
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = _small_star(_large_star(now)).checkpoint()
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``component`` for all rows of ``nodes`` (column ``id``); ``edges`` has ``a`` and ``b``."""
    roots = components(edges, "a", "b")
    return nodes.select("id").join(roots, nodes["id"] == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))
