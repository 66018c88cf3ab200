"""Recommend from tables on the command line.

    python -m lumenlit --candidates C.parquet --library L.parquet --profile "spin liquids" --as-of "2024-02-01 00:00:00" --out reports/run1
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.functions.extract import DEPTHS
from lumenlit.operators import ranking, reporting, state
from lumenlit.plans import recommend
from lumenlit.sources import files


def merged(base: Mapping[str, Any], given: Mapping[str, Any]) -> dict[str, Any]:
    """A tree of settings with another laid over it; a null leaves what it covers."""
    out = dict(base)
    for key, value in given.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else out.get(key) if value is None else value
    return out


#: Where the key of a language model's service is looked for if the settings don't name another variable.
KEY_VARIABLE = "LUMENLIT_API_KEY"


def settings(paths: list[str], environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The first of several JSON files that exists, or nothing, mended.

    Folders that aren't a list become an empty one; the model's key comes from the file or
    else from the environment, under the name that the file gives or ``KEY_VARIABLE``.
    """
    path = next((p for p in paths if Path(p).exists()), None)
    try:
        found = json.loads(Path(path).read_text()) if path else {}
    except ValueError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    if not isinstance(found.get("pdf_folders", []), list):
        found["pdf_folders"] = []
    model = found.get("ai") if isinstance(found.get("ai"), Mapping) else {}
    key = str(model.get("api_key") or "").strip()
    if not key:
        key = (os.environ if environment is None else environment).get(model.get("api_key_env") or KEY_VARIABLE, "").strip()
    return found | {"ai": dict(model) | {"key": key}} if model or key else found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenlit", description=__doc__)
    for name in ("candidates", "library", "profile", "as-of"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--formats", default="markdown,json")
    for name in ("history", "works", "judged", "out", "tag", "config"):
        p.add_argument(f"--{name}")
    p.add_argument("--stop-at", "--stage", choices=recommend.STAGES, default="top")
    p.add_argument("--top-n", "--top", type=int)
    p.add_argument("--candidate-cap", type=int)
    p.add_argument("--min-relevance", type=float)
    p.add_argument("--tau-days", type=float)
    p.add_argument("--no-skip-seen", dest="skip_seen", action="store_false", default=None)
    p.add_argument("--no-fuzzy", dest="fuzzy", action="store_false", default=None)
    p.add_argument("--queries", nargs="+", help="search expressions, any of which a candidate must meet")
    p.add_argument("--categories", nargs="+", help="categories, one of which a candidate must have")
    p.add_argument("--subscribe", action="store_true", default=None, help="take the day's announcements of the categories, without expressions")
    p.add_argument("--no-history", dest="use_history", action="store_false", default=None, help="neither skip nor mark what was recommended before")
    p.add_argument("--no-enrich", dest="use_works", action="store_false", default=None, help="look up no citations")
    p.add_argument("--no-ai", "--refresh", dest="use_judged", action="store_false", default=None, help="use no scores of a judge, kept ones included")
    p.add_argument("--folders", nargs="+", help="folders of PDF files, whose scan is planned first")
    p.add_argument("--index", help="the index of files that were read before")
    p.add_argument("--depth", choices=DEPTHS, default="sections", help="how deeply files are read")
    p.add_argument("--no-fulltext", dest="depth", action="store_const", const="sections", help="the same as --depth sections")
    p.add_argument("--refresh-pdf", action="store_true", help="plan the scan as if no file had been read")
    p.add_argument("--version", action="version", version="lumenlit 0.3")
    return p


INDEX = "path string, size long, mtime timestamp, sha1 string, status string, depth string, seen_at timestamp"


def scan(spark: SparkSession, folders: list[str | Mapping[str, Any]], index: str | None, depth: str, afresh: bool) -> DataFrame:
    """What is to be done with each file of the folders; only those that size and time leave undecided are opened."""
    listing = files.scan_enabled(spark, [{"path": f} if isinstance(f, str) else dict(f) for f in folders])
    known = spark.read.parquet(index) if index and not afresh else spark.createDataFrame([], INDEX)
    return state.plan_scan(listing, known, depth, files.hash_files)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumenlit").getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    known = {f.name for f in fields(recommend.Options)}
    told = settings([a.config] if a.config else [])
    given = merged({k: v for k, v in told.items() if k in known}, {k: v for k, v in vars(a).items() if k in known and v is not None})
    options = recommend.Options(as_of=a.as_of).override(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    if folders := a.folders or told.get("pdf_folders"):
        state.scan_stats(scan(spark, folders, a.index, a.depth, a.refresh_pdf)).show()
    run = recommend.Recommendation(recommend.with_keys(read(a.candidates)), recommend.with_keys(read(a.library)), a.profile, options, read(a.history), read(a.works), read(a.judged))
    df = run.plan(a.stop_at)
    if a.out and a.stop_at == "top":
        linked = lambda x: x.withColumn("url", F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"))
        ranked = linked(ranking.batches(df, ranking.rank_order(), options.top_n).withColumn("rank", (F.col("place") + 1).cast("int"))).drop("batch", "place")
        scored, now = linked(run.plan("scored")), F.lit(a.as_of).cast("timestamp_ntz")
        counted = reporting.run_stats(scored, options.min_relevance, now).first()
        queries = [] if options.subscribe else list(options.queries)
        stats = {"candidates_raw": run.searched().count(), "candidates_after_dedup": counted["candidates"], "library_total": run.library.count(), "queries_used": len(queries)}
        profile = {"summary": a.profile, "queries": queries, "generated_by": "manual"}
        lines = reporting.report_lines(ranked, now, a.as_of, stats, profile, scored, weights=options.weights)
        print("\n".join(reporting.write_report(a.formats.split(","), a.out, a.as_of, a.tag or "", lines, ranked, stats, profile)))
    df.show(10)


if __name__ == "__main__":
    main()
