"""Folders of files, the command line, streams of announcements."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenlit import __main__ as command
from lumenlit.functions import text
from lumenlit.operators import reporting, state
from lumenlit.sources import files
from lumenlit.streaming import announcements


def test_folders_of_papers(spark, tmp_path):
    for name in ("a/one.pdf", "a/two.PDF", "a/deep/three.pdf", "a/.hidden/no.pdf", "a/node_modules/no.pdf", "a/supplement.pdf", "a/note.txt", "b/four.pdf", "b/deep/five.pdf", "c/six.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    folders = [{"path": f"{tmp_path}/a"}, {"path": f"{tmp_path}/a/deep"}, {"path": f"{tmp_path}/b", "recursive": False}, {"path": f"{tmp_path}/c", "enabled": False}]
    found = files.scan_enabled(spark, folders)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["four.pdf", "one.pdf", "three.pdf", "two.PDF"]
    assert files.scan_enabled(spark, [{"path": "x", "enabled": False}]).count() == 0


def test_files_are_hashed_from_a_table_a_block_at_a_time(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "BLOCK", 3)
    (tmp_path / "one two.pdf").write_bytes(b"0123456789")
    (tmp_path / "kept.pdf").write_bytes(b"kept")
    listed = files.scan_pdfs(spark, [str(tmp_path)])
    index = listed.where(F.col("path").contains("kept")).select("path", "size", "mtime", F.lit("s").alias("sha1"), F.lit("ok").alias("status"), F.lit("fulltext").alias("depth"), F.lit(1).alias("seen_at"))
    listing = listed.unionByName(spark.sql("SELECT '/no/such.pdf' AS path, 1L AS size, current_timestamp() AS mtime"))
    plan = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.action, r.sha1) for r in state.plan_scan(listing, index, "sections", files.hash_files).collect()}
    assert plan == {"one two.pdf": ("parse", hashlib.sha1(b"0123456789").hexdigest()), "kept.pdf": ("reuse", None), "such.pdf": ("failed", None)}


def test_readers_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("p", b"one|two"), ("q", b""), ("r", b"bad")], "path string, content binary")

    def reader(content):
        if content == b"bad":
            raise ValueError(content)
        return content.decode().split("|")

    got = {r.path: (r.status, r.pages) for r in files.read_pages(df, reader).collect()}
    assert got == {"p": ("ok", ["one", "two"]), "q": ("notext", [""]), "r": ("error", [])}
    (tmp_path / "arxiv_recommend_20240101_000000.md").write_text("| 1 |\nx")
    (tmp_path / "other.md").write_text("y")
    assert [r.text for r in files.read_reports(spark, str(tmp_path)).collect()] == ["| 1 |\nx"]
    assert files.NoModel().complete("anything") == "" and not files.NoModel.available
    keys = spark.createDataFrame([("a  b", "m", None), ("a b", "m", None), ("a b", "n", None)], "p string, m string, o string").select(files.memo_key(F.col("p"), F.col("m"), F.col("o")).alias("k"))
    assert len({r.k for r in keys.collect()}) == 2


def test_settings():
    assert command.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": None, "c": 5}, "e": 6}) == {"a": {"b": 1, "c": 5}, "d": 3, "e": 6}
    assert command.settings(["/nowhere/x.json"], {}) == {}


def test_settings_are_mended(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"pdf_folders": None, "ai": {"api_key": " ", "api_key_env": "OWN"}, "top_n": 3}))
    assert command.settings([str(path)], {"OWN": " k "}) == {"pdf_folders": [], "ai": {"api_key": " ", "api_key_env": "OWN", "key": "k"}, "top_n": 3}
    path.write_text(json.dumps({"pdf_folders": "x", "ai": {"api_key": "mine"}}))
    assert command.settings([str(path)], {command.KEY_VARIABLE: "k"}) == {"pdf_folders": [], "ai": {"api_key": "mine", "key": "mine"}}
    assert command.settings([], {command.KEY_VARIABLE: "k"}) == {"ai": {"key": "k"}}
    path.write_text("{")
    with pytest.raises(ValueError, match="no JSON"):
        command.settings([str(path)])


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    rows = [(i, 0, i, f"title number {i} about spin chains", "text of spin chains " * (1 + i % 3), f"24{i:02d}.00001", "", "cs", None, 7 * i, "", "") for i in range(12)]
    cols = "id long, pool int, row long, title string, abstract string, arxiv_id string, doi string, category string, published timestamp, citations int, journal_ref string, comments string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame(rows[:2], cols).write.parquet(f"{tmp_path}/l")
    (tmp_path / "s.json").write_text(json.dumps({"top_n": 4, "min_relevance": 0.0}))
    command.main(["--candidates", f"{tmp_path}/c", "--library", f"{tmp_path}/l", "--profile", "spin chains", "--as-of", "2024-02-01 00:00:00", "--config", f"{tmp_path}/s.json", "--out", f"{tmp_path}/out", "--no-fuzzy"])
    report = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/arxiv_recommend_20240201_000000.md").collect())
    items = reporting.parse_reports(spark.createDataFrame([("r", report)], "report string, text string")).collect()
    assert len(items) == 4 and "评分 = 相关性 ×0.60" in report and "| 文献库总量 | 2 篇 |" in report
    told = json.loads(spark.read.text(f"{tmp_path}/out/arxiv_recommend_20240201_000000.json").first().value)
    assert [r["rank"] for r in told["recommendations"]] == [1, 2, 3, 4]


def test_command_line_options(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(spark, "stop", lambda: None)
    rows = [(i, 0, i, f"title number {i} about spin chains", "text of spin chains", f"24{i:02d}.00001", "", "cs" if i % 2 else "ph", dt.datetime(2024, 2, 1 + i // 6), 7 * i, "", "") for i in range(12)]
    cols = "id long, pool int, row long, title string, abstract string, arxiv_id string, doi string, category string, published timestamp, citations int, journal_ref string, comments string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([], cols).write.parquet(f"{tmp_path}/l")
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "one.pdf").write_bytes(b"1")
    base = ["--candidates", f"{tmp_path}/c", "--library", f"{tmp_path}/l", "--profile", "spin chains", "--as-of", "2024-02-02 08:00:00", "--no-fuzzy"]
    shown = []
    monkeypatch.setattr(type(spark.range(1)), "show", lambda df, *a: shown.append([tuple(r) for r in df.collect()]))
    run = lambda *more: (command.main([*base, *more]), sorted(r[0] for r in shown[-1]))[1]
    assert run("--stage", "candidates") == list(range(12))
    assert run("--stage", "candidates", "--categories", "ph") == [0, 2, 4, 6, 8, 10]
    assert run("--stage", "candidates", "--queries", "ti:3", "ti:5 AND ti:chains", "--categories", "cs") == [3, 5]
    assert run("--stage", "candidates", "--subscribe", "--categories", "cs", "--queries", "ti:3") == [7, 9, 11]
    assert run("--stage", "candidates", "--folders", f"{tmp_path}/pdf", "--refresh-pdf", "--depth", "fulltext") == list(range(12))
    assert shown[-2][0][0] == 1  # one file is planned
    with pytest.raises(ValueError, match="category"):
        run("--stage", "candidates", "--subscribe")
    with pytest.raises(SystemExit):
        command.main(["--version"])
    options = command.parser().parse_args([*base, "--no-history", "--no-enrich", "--refresh", "--no-fulltext"])
    assert (options.use_history, options.use_works, options.use_judged, options.depth) == (False, False, False, "sections")


def test_daily_counts(spark):
    df = spark.createDataFrame([("a", "2024-01-01 05:00:00", "new"), ("b", "2024-01-01 06:00:00", "new"), ("c", "2024-01-02 05:00:00", "cross")], "arxiv_id string, at string, announce_type string").withColumn("at", F.col("at").cast("timestamp"))
    got = {(str(r.day.start), r.announce_type): r.n for r in announcements.daily_counts(df).collect()}
    assert got == {("2024-01-01 00:00:00", "new"): 2, ("2024-01-02 00:00:00", "cross"): 1}


def test_shown_fields(spark):
    df = spark.createDataFrame([(["a", " ", "b"], None, None, " "), ([], "2024-01-02", "2020-01-01", "J" * 40)], "a array<string>, p string, u string, j string")
    got = df.select(text.author_line(F.col("a")).alias("a"), text.shown_date(F.col("p").cast("timestamp_ntz"), F.col("u").cast("timestamp_ntz")).alias("d"), text.shown_journal(F.col("j")).alias("j")).collect()
    assert [tuple(r) for r in got] == [("a 等", "—", "—"), ("—", "2024-01-02", "J" * 24 + "…")]
