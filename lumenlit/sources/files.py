"""Folders of files as tables, and the external services as interfaces.

A paper's pages come from a reader that the caller plugs in (``reader(bytes) -> list of
page texts``); it runs in the tasks, a file at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.functions.extract import is_skipped
from lumenlit.functions.text import clean_text
from lumenlit.operators import reporting
from lumenlit.session import ship, spread

# Folders that are never read.
RUN_FILE = reporting.FILE_NAME
PRUNED = (r"\.[^/]*", "node_modules", "__pycache__", r"\.trash")


def scan_pdfs(spark: SparkSession, folders: list[str], recursive: bool = True, skip: bool = True) -> DataFrame:
    """``path``, ``size``, ``mtime`` of the PDF files in folders; each path once, hidden folders pruned."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folders).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    found = found.where(~F.col("path").rlike("/(?:" + "|".join(PRUNED) + ")/")).dropDuplicates(["path"])
    return found.where(~is_skipped(F.element_at(F.split("path", "/"), -1))) if skip else found


def scan_enabled(spark: SparkSession, folders: list[dict[str, Any]], skip: bool = True) -> DataFrame:
    """The files of the folders that are switched on (``path``, ``enabled``, ``recursive``), each file once."""
    found = None
    for deep in (True, False):
        some = [f["path"] for f in folders if f.get("enabled", True) and f.get("recursive", True) == deep]
        if some:
            part = scan_pdfs(spark, some, deep, skip)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "path string, size long, mtime timestamp") if found is None else found.dropDuplicates(["path"])


#: Bytes of a file that a task holds at once.
BLOCK = 1 << 20


def opened(path: str) -> BinaryIO:
    """A file of any store that Arrow can reach by its address, for reading."""
    if ":" not in path or path.startswith("file:"):
        return open("/" + unquote(path.removeprefix("file:").lstrip("/")), "rb")
    store, inner = pa.fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def hash_files(paths: DataFrame, opener: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """``path``, ``sha1`` of whole files, null where one can't be read.

    The files are named by a table, so those that another plan has left are opened and no
    others; tasks read them a block at a time, whatever their size.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: list[str | None] = []
            for path in batch.column(0).to_pylist():
                try:
                    digest = hashlib.sha1()
                    with opener(path) as file:
                        while block := file.read(BLOCK):
                            digest.update(block)
                    told.append(digest.hexdigest())
                except (OSError, pa.ArrowException):
                    told.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["path", "sha1"])

    ship(paths.sparkSession)
    return spread(paths.select("path")).mapInArrow(work, "path string, sha1 string")


def read_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """``path``, ``status`` (ok, notext, error), ``pages`` of files with ``path`` and ``content``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple[str, str, list[str]]] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    pages = [p or "" for p in reader(bytes(content))]
                    rows.append((path, "ok" if "".join(pages).strip() else "notext", pages))
                except Exception:  # a broken file is a row with that status
                    rows.append((path, "error", []))
            yield pd.DataFrame(rows, columns=["path", "status", "pages"])

    return files.select("path", "content").mapInPandas(work, "path string, status string, pages array<string>")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """``report`` (path) and ``text`` of past reports, one row for each file."""
    files = spark.read.option("pathGlobFilter", "*recommend_*.md").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def list_runs(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Past runs, the newest first: ``report``, ``generated_at``, ``items`` (how many) and ``label``.

    ``reports`` has ``report`` (path), ``text`` and, where files are listed, ``mtime`` as text;
    ``items`` are those of ``reporting.parse_reports``. Only files that are named like a report
    count; a report without its time is placed by its file's, and named by its name's.
    """
    named = reports.where(F.element_at(F.split("report", "/"), -1).rlike(RUN_FILE))
    counted = items.groupBy("report").agg(F.count(F.lit(1)).alias("n"))
    made = F.regexp_extract("text", reporting.STAMP, 1)
    runs = named.join(counted, "report", "left").withColumns({"generated_at": made, "items": F.coalesce("n", F.lit(0))})
    runs = runs.withColumn("label", reporting.run_label(F.col("report"), F.col("generated_at"), F.col("items")))
    when = F.coalesce(F.nullif(F.col("generated_at"), F.lit("")), F.col("mtime") if "mtime" in reports.columns else F.lit(""), F.lit(""))
    return runs.orderBy(F.desc(when), "report").select("report", "generated_at", "items", "label")


def memo_key(prompt: Column, model: Column, options: Column) -> Column:
    """The key under which the answer to a request is kept: what is asked, of whom and how, white space aside."""
    return F.sha2(F.concat_ws("\u0001", clean_text(prompt), F.coalesce(model, F.lit("")), F.coalesce(options, F.lit(""))), 256)


def memoised(keys: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers (``key``, ``value``) from a cache table, and from ``answer`` only for keys it lacks."""
    known = cache.join(keys.select("key").distinct(), "key", "left_semi")
    return known.unionByName(answer(keys.select("key").distinct().join(cache, "key", "left_anti")).select(*cache.columns))


class NoModel:
    """The language model that isn't there: every request is answered by nothing."""

    available = False

    def complete(self, prompt: str, **options: Any) -> str:
        return ""
