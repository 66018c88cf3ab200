"""Registered queries of joins and windows over time and of statistics at several levels; SQL in DuckDB's dialect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.operators import state, temporal, versions
from lumenlit.operators.graph import shared_folder
from lumenlit.queries import _FILES, _PAPERS, _UPSERTED, _files, _history, papers, query, table
from lumenlit.queries_runs import _ITEMS, _TITLE, _line, _rss
from lumenlit.sources import readers

_NTZ = "timestamp_ntz"

_SHIPPED = "c AS (SELECT l_orderkey, l_linenumber, o_custkey AS k, l_shipdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), h AS (SELECT o_custkey AS k, o_orderdate AS t, max(o_orderkey) AS report, arg_max(o_orderpriority, o_orderkey) AS summary FROM orders GROUP BY ALL)"


@query(f"WITH {_SHIPPED} SELECT c.l_orderkey, c.l_linenumber, CAST(c.t AS TIMESTAMP) AS arrived, h.report, h.summary FROM c ASOF LEFT JOIN h ON c.k = h.k AND c.t >= h.t")
def history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the history of a customer's orders said last when each of their items arrived."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    left = items.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("key"), F.col("l_shipdate").cast(_NTZ).alias("at"))
    right = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast(_NTZ).alias("at"), F.col("o_orderkey").alias("report"), F.col("o_orderpriority").alias("summary"))
    return temporal.as_of(left, right, "key", "at", ["report", "summary"]).select("l_orderkey", "l_linenumber", F.col("at").alias("arrived"), "report", "summary")


_RUNS = "r AS (SELECT o_orderkey AS run, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 173 % 43200) AS first, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 173 % 43200 + CASE WHEN o_orderkey % 500 = 7 THEN 20000 ELSE o_custkey % 180 END) AS last FROM orders)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the month of the announcements, most of them some hours long, some many days, some empty."""
    begin, length = F.col("o_orderkey") * 173 % 43200, F.when(F.col("o_orderkey") % 500 == 7, 20000).otherwise(F.col("o_custkey") % 180)
    minutes = lambda n: F.lit("2024-01-01 00:00:00").cast(_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), minutes(begin).alias("first"), minutes(begin + length).alias("last"))


@query(f"WITH {_RUNS} SELECT run, count(*) AS n, CAST(min(ts) AS TIMESTAMP) AS earliest, CAST(sum(event_id) AS BIGINT) AS ids FROM r JOIN events ON first <= ts AND ts < last GROUP BY run")
def announcements_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run the announcements that its span holds."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast(_NTZ).alias("ts"))
    runs = _runs(spark, sf_dir)
    held = runs.join(temporal.held_totals(events, runs, "ts", "first", "last", "event_id"), ["first", "last"])
    return held.groupBy("run").agg(F.sum("n").alias("n"), F.min("earliest").alias("earliest"), F.sum("total").alias("ids"))


_ARRIVED = "e AS (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS batch, CAST(ts AS TIMESTAMP) - to_minutes(event_id * 7 % 97 * CASE WHEN event_id % 13 = 5 THEN 8 ELSE 1 END) AS \"at\" FROM events), b AS (SELECT batch, max(max(\"at\")) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOURS AS mark FROM e GROUP BY batch), m AS (SELECT * FROM e JOIN b USING (batch))"


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in hourly batches, some minutes or hours after they happened."""
    late = F.col("event_id") * 7 % 97 * F.when(F.col("event_id") % 13 == 5, 8).otherwise(1)
    at = F.col("ts").cast(_NTZ) - F.make_dt_interval(F.lit(0), F.lit(0), late.cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", "ts").alias("batch"), at.alias("at"))


@query(f"WITH {_ARRIVED}, k AS (SELECT *, CASE WHEN \"at\" - lag(\"at\") OVER (PARTITION BY user_id ORDER BY \"at\") < INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS starts FROM m WHERE mark IS NULL OR \"at\" + INTERVAL 45 MINUTES > mark), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY \"at\") AS no FROM k) SELECT user_id, min(\"at\") AS \"begin\", max(\"at\") + INTERVAL 45 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY user_id, no")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.sessions(_arrived(spark, sf_dir), "user_id", "at", "45 MINUTES", "batch", "2 HOURS")


@query(f"WITH {_ARRIVED} SELECT event_id, \"at\" FROM m WHERE \"at\" + INTERVAL 45 MINUTES <= mark")
def late_for_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.late_for_sessions(_arrived(spark, sf_dir), "at", "45 MINUTES", "batch", "2 HOURS").select("event_id", "at")


@query(f"WITH {_ARRIVED}, w AS (SELECT event_type, mark, make_timestamp((epoch_us(\"at\") // 21600000000 - i) * 21600000000) AS \"begin\" FROM m, (SELECT unnest([0, 1, 2, 3]) AS i)) SELECT event_type, \"begin\", count(*) FILTER (mark IS NULL OR \"begin\" + INTERVAL 24 HOURS > mark) AS n, count(*) FILTER (\"begin\" + INTERVAL 24 HOURS <= mark) AS late FROM w GROUP BY event_type, \"begin\"")
def hopping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.hopping(_arrived(spark, sf_dir), "event_type", "at", "24 HOURS", "6 HOURS", "batch", "2 HOURS")


@query(f"WITH {_FILES}, d AS (SELECT status, CASE WHEN covers THEN 'whole' END AS depth, size FROM idx) SELECT status, depth, CAST(grouping_id(status, depth) AS BIGINT) AS level, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, max(size) AS largest FROM d GROUP BY CUBE (status, depth)")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index counted by status, by depth, by both and over all."""
    index = _files(spark, sf_dir)[1].withColumn("depth", F.when(F.col("depth") != "metadata", "whole"))
    return temporal.levels(index, ["status", "depth"], [F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("size").alias("largest")])


@query(f"WITH {_PAPERS}, d AS (SELECT year(published) AS year, category, source, citations FROM papers) SELECT year, category, source, CAST(grouping_id(year, category, source) AS BIGINT) AS level, count(*) AS n, count(DISTINCT source) AS sources, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations FROM d GROUP BY ROLLUP (year, category, source)")
def run_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a run by year, category and source, drilled down."""
    df = papers(spark, sf_dir).withColumn("year", F.year("published").cast("long"))
    return temporal.levels(df, ["year", "category", "source"], [F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations")], drill=True)


# --- tables that are written first --------------------------------------------------------


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A new folder that all executors share."""
    shared_folder(table(spark, sf_dir, "nation"))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(f"{_ITEMS} SELECT 'f' || id % 40 AS feed, lower(arxiv_id) AS arxiv_id, {_line(_TITLE)} AS title, published FROM r WHERE kind = 'new'")
def announced_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New announcements of feeds that were written as files, a folder for each category."""
    number = F.regexp_extract("category", r"(\d+)$", 1).cast("long") % 40
    folder = _folder(spark, sf_dir, "feeds")
    _rss(spark, sf_dir).select(F.concat(F.lit("f"), number.cast("string")).alias("category"), F.col("xml").alias("value")).write.partitionBy("category").text(folder)
    return readers.read_feeds(spark, folder, ("new",), lines=True).select("feed", "arxiv_id", "title", "published")


@query(_UPSERTED)
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of one version in buckets, with a batch merged into it."""
    events = _history(spark, sf_dir)
    blank = {c: F.lit("") for c in ("title", "ideas", "authors", "published", "journal", "categories", "profile_fp")} | {"citations": F.lit(None).cast("int")}
    buckets, folder = max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))), _folder(spark, sf_dir, "history")
    versions.saved(state.replay(events.where("at < '2000-01-01'")).withColumns(blank), folder, 1, buckets)
    batch = state.newest_by(events.where("at >= '2000-01-01'"), "arxiv_id", [F.desc("at"), F.desc("report")]).withColumns(blank)
    return versions.upserted(spark, folder, 1, batch, buckets).select("arxiv_id", "first_at", "last_at", "times", "best_score", "report", "analyzed", "summary")
