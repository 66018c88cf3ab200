"""Feeds and reports by name: the rows of the parsers, filters that reach the reader."""

import datetime as dt

from pyspark.sql import functions as F

from lumenlit.sources import feeds, readers

HEAD = '<rss xmlns:arxiv="a" xmlns:dc="d"><channel>'


def item(n, kind, more=""):
    return f"<item><title>T {n} &amp; co</title><link>https://arxiv.org/abs/2401.{n:05d}v2</link><description>arXiv:2401.{n:05d} Announce Type: {kind} \n Abstract: caf&amp;eacute; {n}</description><category>cs</category><category>{more or 'x'}</category><pubDate>Mon, 24 Feb 2025 00:00:00 -0500</pubDate><arxiv:announce_type>{kind}</arxiv:announce_type><dc:creator>A {n}</dc:creator><dc:creator> </dc:creator></item>"


def test_feeds_by_name_are_those_of_the_parser(spark, tmp_path):
    made = {"cs.LG": HEAD + item(1, "new") + item(2, "cross") + item(3, "replace") + "<item><title>none</title></item></channel></rss>", "cond-mat": HEAD + item(4, "new", "y") + "</channel></rss>", "broken": HEAD + item(5, "new"), "empty": "<rss></rss>"}
    for name, xml in made.items():
        (tmp_path / f"{name}.xml").write_text(xml)
    (tmp_path / "_hidden.xml").write_text(made["cs.LG"])
    (tmp_path / "note.md").write_text("x")
    columns = ["arxiv_id", "title", "abstract", "authors", "published", "announce_type", "categories", "primary_category", "feed", "place"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    plain = spark.createDataFrame(list(made.items()), "category string, xml string").where("category <> 'broken'")
    for types in (("new", "cross"), ("replace",), None):
        assert rows(readers.read_feeds(spark, str(tmp_path), types)) == rows(feeds.parse_rss(plain, types=types))
    got = readers.read_feeds(spark, f"file://{tmp_path}")
    assert {r.abstract for r in got.collect()} == {"café 1", "café 2", "café 4"}
    assert spark.read.format("announcement_feeds").load(str(tmp_path)).where("announce_type = 'new' and announce_type = 'cross'").count() == 0


def test_types_and_feeds_are_filtered_by_the_reader(spark, tmp_path):
    for k in range(3):
        folder = tmp_path / f"category=c{k}"
        folder.mkdir()
        (folder / "part-0.txt").write_text("\n".join((HEAD + item(10 * k + i, kind) + "</channel></rss>").replace("\n", " ") for i, kind in enumerate(("new", "cross", "replace", "new"))))
    readers.register(spark)
    items = spark.read.format("announcement_feeds").option("lines", "true").load(str(tmp_path)).where((F.col("announce_type") == "new") & F.col("feed").isin("c1", "c2", "nowhere") & (F.col("place") >= 0))
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "new" not in plan.split("BatchScan")[0] and "place" in plan.split("BatchScan")[0]  # what is left to Spark
    assert sorted((r.feed, r.link[-4:-2]) for r in items.collect()) == [("c1", "10"), ("c1", "13"), ("c2", "20"), ("c2", "23")]
    reader = readers.FeedReader({"path": str(tmp_path), "lines": "true"})
    left = list(reader.pushFilters([readers.In(("feed",), ("c1",)), readers.EqualTo(("announce_type",), "new"), readers.GreaterThan(("place",), 0)]))
    assert [f.attribute for f in left] == [("place",)] and [p.name for p in reader.partitions()] == ["c1"]
    assert [row[8] for row in reader.read(reader.partitions()[0])] == ["new", "new"]


def test_reports_are_opened_by_their_time(spark, tmp_path):
    for name in ("arxiv_recommend_20240101_120000.md", "arxiv_recommend_20240301_000000_spin.md", "arxiv_recommend_20249999_000000.md", "other.md"):
        (tmp_path / name).write_text(f"text of {name}")
    readers.register(spark)
    reports = spark.read.format("past_reports").load(str(tmp_path))
    assert sorted((r.made, r.label) for r in reports.where("made is not null").collect()) == [(dt.datetime(2024, 1, 1, 12), ""), (dt.datetime(2024, 3, 1), "spin")]
    assert reports.count() == 3
    assert [r.label for r in reports.where(F.col("made") >= F.lit(dt.datetime(2024, 2, 1))).collect()] == ["spin"]
    reader = readers.ReportReader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([readers.GreaterThan(("made",), dt.datetime(2024, 2, 1))])) and len(reader.partitions()) == 1
    assert reports.where(F.col("made") > F.lit(dt.datetime(2025, 1, 1))).count() == 0


def test_a_page_title_keeps_what_was_cut_off_of_an_entity(spark):
    pages = spark.createDataFrame([("<TITLE lang=en>A &amp;&lt;b&#39; &amp;amp</title>",), ("<title>x &nbsp;&quot;&gt; &am &#39</title>",)], "html string")
    assert [r.title for r in feeds.page_titles(pages).collect()] == ["A &<b' &amp", 'x "> &am &#39']
