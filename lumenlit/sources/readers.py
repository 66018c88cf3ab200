"""Folders of feeds and of past reports as data sources that Spark can load by name.

A file is a partition, so tasks read side by side; which feeds, which types of
announcement and which time a query asks for reaches the reader, which then doesn't open
the other files, or doesn't hand on the other items.

    readers.register(spark)
    spark.read.format("announcement_feeds").load(folder).where("announce_type = 'new'")
    spark.read.format("past_reports").load(folder).where("made >= '2024-01-01'")
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any
from urllib.parse import unquote

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lumenlit.operators.reporting import FILE_NAME
from lumenlit.session import ship
from lumenlit.sources.feeds import announced
from lumenlit.sources.files import opened

ITEMS = "feed string, place int, title string, link string, guid string, description string, category array<string>, pubDate string, announce_type string, creator array<string>"
REPORTS = "report string, made timestamp, label string, text string"
#: Compares of a time that a report's name can answer.
_ORDER = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


def listed(folder: str, pattern: str) -> list[str]:
    """Addresses of the files below a folder whose name matches, hidden ones left out, in order."""
    if ":" not in folder or folder.startswith("file:"):
        store, inner, head = pyarrow.fs.LocalFileSystem(), "/" + unquote(folder.removeprefix("file:").lstrip("/")), ""
    else:
        store, inner = pyarrow.fs.FileSystem.from_uri(folder)
        head = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    found = store.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    return sorted(head + f.path for f in found if f.type == pyarrow.fs.FileType.File and re.search(pattern, f.base_name) and f.base_name[0] not in "._")


@dataclass
class File(InputPartition):
    """A file, and what its address says of it."""

    path: str
    name: str
    made: datetime | None = None


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.lines = options["path"], options.get("lines", "false").lower() == "true"
        self.wanted: dict[str, set[Any]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality with one or some values of the feed or the announcement type is met here; the rest goes back."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if name not in ("feed", "announce_type"):
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[InputPartition]:
        files = []
        for path in listed(self.folder, r"\.(xml|rss|txt)$"):
            folder = re.search(r"/category=([^/]*)/[^/]*$", path)
            feed = unquote(folder.group(1)) if folder else path.rsplit("/", 1)[1].rsplit(".", 1)[0]
            if "feed" not in self.wanted or feed.strip() in self.wanted["feed"]:
                files.append(File(path, feed.strip()))
        return files or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        with opened(partition.path) as file:
            data = file.read()
        for feed in data.split(b"\n") if self.lines else [data]:
            yield from self.items(partition.name, feed)

    def items(self, name: str, feed: bytes) -> Iterator[tuple]:
        """The items of one feed; a broken one has none."""
        try:
            root = ET.fromstring(feed)
        except ET.ParseError:
            return
        local = lambda node: node.tag.rsplit("}", 1)[-1]
        types = self.wanted.get("announce_type")
        place = -1
        for channel in (c for c in root if local(c) == "channel"):
            for item in (i for i in channel if local(i) == "item"):
                place += 1
                texts: dict[str, list[str | None]] = {}
                for node in item:
                    texts.setdefault(local(node), []).append(node.text)
                one = lambda c: next(iter(texts.get(c, [])), None)
                if types is None or one("announce_type") in types:
                    yield (name, place, *(one(c) for c in ("title", "link", "guid", "description")), texts.get("category"), one("pubDate"), one("announce_type"), texts.get("creator"))


class FeedSource(DataSource):
    """``announcement_feeds``: a row for each item of the feeds in a folder, named by ``category=`` folders or file names.

    With the option ``lines`` every line of a file is a feed.
    """

    @classmethod
    def name(cls) -> str:
        return "announcement_feeds"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(dict(self.options))


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.spans = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Compares of the time are met by the files' names; the rest goes back."""
        for f in filters:
            if type(f) in _ORDER and f.attribute == ("made",) and isinstance(f.value, datetime):
                self.spans.append((type(f), f.value.replace(tzinfo=None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = []
        for path in listed(self.folder, FILE_NAME):
            day, clock, label = re.search(FILE_NAME, path.rsplit("/", 1)[1]).groups()
            try:
                made = datetime.strptime(day + clock, "%Y%m%d%H%M%S")
            except ValueError:
                made = None
            if all(made is not None and _ORDER[kind](made, value) for kind, value in self.spans):
                files.append(File(path, label or "", made))
        return files or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            with opened(partition.path) as file:
                yield partition.path, partition.made, partition.name, file.read().decode("utf-8", "replace")


class ReportSource(DataSource):
    """``past_reports``: a row for each report in a folder, with the time and label of its name."""

    @classmethod
    def name(cls) -> str:
        return "past_reports"

    def schema(self) -> str:
        return REPORTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReportReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, filters included."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(ReportSource)


def read_feeds(spark: SparkSession, folder: str, types: tuple[str, ...] | None = ("new", "cross"), lines: bool = False) -> DataFrame:
    """The papers of ``feeds.parse_rss``, from the files of a folder; other types don't leave the reader."""
    register(spark)
    items = spark.read.format("announcement_feeds").option("lines", str(lines).lower()).load(folder)
    return announced(items if types is None else items.where(items.announce_type.isin(*types)))
