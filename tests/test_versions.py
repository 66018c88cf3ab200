"""Versions of a history in buckets: the same rows, and no shuffle of the old side."""

import datetime as dt
import random

from lumenlit.operators import state, versions

OLD = "arxiv_id string, first_at timestamp, last_at timestamp, times int, best_score double, report long, profile_fp string, analyzed boolean, title string, summary string, ideas string, authors string, published string, journal string, categories string, citations int"
NEW = "arxiv_id string, at timestamp, score double, report long, profile_fp string, analyzed boolean, title string, summary string, ideas string, authors string, published string, journal string, categories string, citations int"


def test_only_the_batch_is_shuffled(spark, tmp_path):
    r = random.Random(2)
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    rest = lambda: tuple(r.choice(("", "x", "y")) for _ in range(7)) + (r.choice((None, 3)),)
    old = spark.createDataFrame([(f"p{i}", day(0), day(1), 2, r.random(), i, "", r.random() < 0.5, *rest()[:7], None) for i in range(200)], OLD)
    batches = [spark.createDataFrame([(f"p{i}", day(2 + k), r.random(), 900 + k, "fp", r.random() < 0.5, *rest()[:7], 3) for i in r.sample(range(400), 60)] + [("", day(2), 1.0, 1, "", True, *rest()[:7], 1)], NEW) for k in range(2)]
    folder, plain = f"file://{tmp_path}/history", old
    versions.saved(old, folder, 0, 16)
    for k, batch in enumerate(batches):
        merged = versions.upserted(spark, folder, k, batch, 16)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        before, after = plan.split("Exchange hashpartitioning", 1)
        assert "FileScan" in before + after and "FileScan" not in after.split("\n", 3)[1]
        versions.saved(merged, folder, k + 1, 16)
        plain = state.upsert_history(plain, batch)
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert key(versions.version(spark, folder, 2, 16)) == key(plain) and plain.count() > 250
    # Another session finds the buckets again.
    spark.sql(f"DROP TABLE {versions._name(folder, 2)}")
    again = versions.version(spark, folder, 2, 16)
    assert key(again) == key(plain)
    joined = again.join(batches[0].select("arxiv_id"), "arxiv_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert versions.version(spark, folder, 0, 16).count() == 200  # what was written before is as it was
