import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from lumenlit.operators import state, temporal
from lumenlit.streaming import announcements, recommended, windows


def announced(i, at, kind="new", **more):
    return {"arxiv_id": i, "at": at, "score": 0.5, "report": 1, "analyzed": False, "summary": None, "announce_type": kind} | more


def written(folder, batches):
    """Files that are read one after another, a batch each."""
    folder.mkdir(exist_ok=True)
    begin = len(list(folder.iterdir()))
    for n, batch in enumerate(batches, begin):
        path = folder / f"{n:03}.json"
        path.write_text("\n".join(map(json.dumps, batch)))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_announcements_are_kept_once(spark, tmp_path):
    row = announced
    written(tmp_path / "in", [[row("a", "2024-01-01T00:00:00"), row("a", "2024-01-01T01:00:00"), row("b", "2024-01-01T02:00:00"), row("c", "2024-01-01T02:00:00", "replace")]])
    for _ in range(2):  # a restart brings nothing twice
        announcements.keep_history(announcements.announcements(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    kept = {r.arxiv_id: r.times for r in announcements.history(spark, str(tmp_path / "out")).collect()}
    assert kept == {"a": 1, "b": 1}


def test_sessions_and_late_rows_of_a_stream_are_those_of_the_batches(spark, tmp_path):
    r = random.Random(5)
    batches = [[{"k": r.choice("abc"), "at": str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=120 * n + r.randrange(130) - (500 if r.random() < 0.1 else 0), seconds=r.randrange(60), microseconds=r.randrange(10**6))).replace(" ", "T")} for _ in range(25)] for n in range(8)]
    written(tmp_path / "in", batches)
    schema = "k string, at timestamp"
    out = windows.session_stream(streamed(spark, tmp_path / "in", schema), "k", "at", "20 MINUTES", "60 MINUTES")
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(180)
    windows.keep_late(streamed(spark, tmp_path / "in", schema), "at", "20 MINUTES", "60 MINUTES", str(tmp_path / "side"), str(tmp_path / "ck2")).awaitTermination(180)
    rows = spark.createDataFrame([(x["k"], x["at"], n) for n, b in enumerate(batches) for x in b], "k string, t string, batch int").select("k", F.to_timestamp("t").alias("at"), "batch")
    closed = rows.agg(F.max("at") - F.expr("INTERVAL 60 MINUTES")).first()[0]
    batch = temporal.sessions(rows, "k", "at", "20 MINUTES", "batch", "60 MINUTES", 2)
    want = sorted(tuple(x) for x in batch.where(F.col("end") <= F.lit(closed)).collect())
    assert sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("k", "begin", "end", "n").collect()) == want and len(want) > 20
    late = temporal.late_for_sessions(rows, "at", "20 MINUTES", "batch", "60 MINUTES", 2)
    side = spark.read.parquet(str(tmp_path / "side" / "late"))
    assert sorted((x.batch, x.k, x.at) for x in side.collect()) == sorted((x.batch, x.k, x.at) for x in late.collect()) and late.count() > 5


FIELDS = ["arxiv_id", "first_at", "last_at", "times", "best_score", "report", "summary", "analyzed"]


def test_recommended_papers_are_state_that_outlives_a_restart(spark, tmp_path):
    r = random.Random(3)
    when = lambda: f"2024-01-0{r.randint(1, 6)}T{r.randint(0, 23):02}:00:00"
    make = lambda k: announced(r.choice("abcdefgh "), when(), score=r.choice((None, r.random())), report=k, analyzed=r.random() < 0.4, summary=r.choice((None, f"s{k}")))
    batches = [[make(10 * n + k) for k in range(10)] for n in range(6)]
    said = lambda: recommended.recommended(streamed(spark, tmp_path / "in", announcements.SCHEMA), "30 days")

    def run():
        store = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        said().writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)

    for part in (batches[:3], batches[3:]):  # the second run begins with the state of the first
        written(tmp_path / "in", part)
        run()
    events = spark.createDataFrame([x for b in batches for x in b], "arxiv_id string, at string, score double, report long, analyzed boolean, summary string, announce_type string").withColumn("at", F.to_timestamp("at"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = sorted((tuple(x[f] for f in FIELDS) for x in state.replay(events).collect()), key=repr)
    assert sorted((tuple(x[f] for f in FIELDS) for x in recommended.latest(out).collect()), key=repr) == want and len(want) == 8
    assert out.where("not seen_before").count() == 8 and out.count() == events.where("arxiv_id <> ' '").count()


def test_a_kept_history_begins_the_state_and_old_papers_are_forgotten(spark, tmp_path):
    known = spark.createDataFrame([("old", dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 1), 3, 0.9, 7, "why", True)], "arxiv_id string, first_at timestamp, last_at timestamp, times int, best_score double, report long, summary string, analyzed boolean")
    batches = [[announced("old", "2024-01-02T00:00:00"), announced("new", "2024-01-02T00:00:00")], [announced("x", "2024-03-01T00:00:00")], [announced("old", "2024-03-02T00:00:00")], [announced("y", "2024-03-03T00:00:00")]]
    written(tmp_path / "in", batches)
    said = recommended.recommended(streamed(spark, tmp_path / "in", announcements.SCHEMA), "1 hour", dt.timedelta(days=30), known)
    store = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    said.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(240)
    got = [(x.arxiv_id, x.seen_before, x.expired, x.times) for x in spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "arxiv_id", "times").collect()]
    assert ("old", True, False, 4) in got and ("new", False, False, 1) in got
    assert ("old", True, True, 4) in got and ("new", True, True, 1) in got  # forgotten after a month
    assert ("old", False, False, 1) in got  # and new again
