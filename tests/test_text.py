import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlit.functions import extract, scoring, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("https://arxiv.org/abs/2401.12345v2", "2401.12345"), ("http://arxiv.org/pdf/2401.12345.pdf", "2401.12345"), ("arXiv:2401.12345v11 [cs.LG]", "2401.12345"),
        ("https://example.com/2024.12345", ""), ("see arXiv https://example.com 2401.12345", "2401.12345"), ("Cond-Mat/0701001v3", "cond-mat/0701001"), ("2401.1234", "2401.1234"), ("", ""), (None, ""), ("nothing", ""),
    ],
)
def test_identifier(spark, given, expected):
    assert one(spark, text.arxiv_id, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("https://doi.org/10.1/Ab.", "10.1/ab"), ("DOI: 10.1/X", "10.1/x"), ("doi 10.1/x", "10.1/x"), (None, ""), ("10.1/y..", "10.1/y")])
def test_doi(spark, given, expected):
    assert one(spark, text.norm_doi, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("Ünïted  Fields!", "united fields"), (r"The $x_{n}$ \alpha case", "the case"), ("½ of ﬁve²", "1 2 of five2"), (None, ""), ("相变 & order", "相变 order")])
def test_normalised_title(spark, given, expected):
    assert one(spark, text.normalize_title, given) == expected


def test_truncate(spark):
    cut = lambda c: text.truncate(c, 20)
    assert one(spark, cut, "short") == "short"
    assert one(spark, cut, "one two three. four five six") == "one two three.…"
    assert one(spark, cut, "x" * 30) == "x" * 20 + "…"
    assert one(spark, cut, None) == ""


def test_lists(spark):
    assert one(spark, text.split_tags, " a, b；a;;c，" + "x" * 50) == ["a", "b", "c", "x" * 40]
    assert one(spark, text.distinct_ignoring_case, ["A", " a", "", None, "b"], "array<string>") == ["A", "b"]
    assert one(spark, lambda c: text.author_line(c, 3), ["a", "b", "c", "d"], "array<string>") == "a, b, c 等"
    assert one(spark, lambda c: text.grams(text.tokens(c), ["the"]), "The red of the fox") == ["red", "of", "fox", "red of", "of fox"]


def test_dates(spark):
    assert one(spark, text.rfc822, "Mon, 05 Feb 2024 00:00:00 -0500") == dt.datetime(2024, 2, 5)
    assert one(spark, text.rfc822, "garbage") is None
    assert one(spark, text.parse_month_date, "Submitted 25 September, 2026") == dt.date(2026, 9, 25)
    assert one(spark, text.parse_month_date, "2020") == dt.date(2020, 1, 1)
    assert one(spark, lambda c: text.parse_year(c, 2024), "in 1799 and 1850") == 1850
    assert one(spark, lambda c: text.parse_year(c, 2024), "2099") is None
    assert one(spark, text.int_or_null, "3.0") == 3
    assert one(spark, text.int_or_null, "3.5") is None


def test_titles(spark):
    for junk in ("Cjr", "!$#\"%'&()", "Supplementary Information for something", "Reviewer's comments on it", "LETTERS of", "Comments on the manuscript by X"):
        assert one(spark, extract.classify_title, junk).startswith("junk"), junk
    for good in ("Comment on 'Superfluid stiffness'", "Phase transitions in spin chains", "相变与临界现象的研究进展综述"):
        assert one(spark, extract.classify_title, good) == "paper", good
    assert one(spark, extract.classify_title, "We show this. Then that follows. " * 6).startswith("junk:prose")


PAGE = "Title\n1. Introduction\n" + "Words of the introduction come here and go on for long. " * 6 + "\nAcknowledgments\nthanks\nIII. Conclusions\n" + "In the end all is well and we see the point of it now. " * 4 + "\nReferences\n[1] Someone 1999 arXiv:1111.22222 10.1000/other"


def test_sections(spark):
    assert one(spark, extract.introduction, PAGE).startswith("Words of the introduction")
    assert "thanks" not in one(spark, extract.introduction, PAGE)
    assert one(spark, extract.conclusion, PAGE).startswith("In the end")
    assert "Someone" not in one(spark, extract.conclusion, PAGE)
    assert one(spark, extract.conclusion, "no headings at all") == ""
    assert one(spark, lambda c: extract.head_ids(c)[0], PAGE) == ""
    assert one(spark, lambda c: extract.head_ids(c)[0], "arXiv:2401.00001v2 \n" + PAGE) == "2401.00001"
    assert one(spark, extract.dehyphenate, "quan- tum and sign- problem") == "quantum and sign- problem"


def test_depth_and_year(spark):
    row = spark.range(1).select(
        extract.depth_covers(F.lit("fulltext"), F.lit("sections")).alias("a"), extract.depth_covers(F.lit(""), F.lit("metadata")).alias("b"), extract.depth_covers(F.lit("metadata"), F.lit("sections")).alias("c"),
        extract.paper_year(F.lit("9912.12345"), F.lit(""), F.lit(""), F.lit(""), 2024).alias("y1"), extract.paper_year(F.lit(""), F.lit(None).cast("string"), F.lit("in 2012 and 2003"), F.lit(""), 2024).alias("y2"), extract.paper_year(F.lit(""), F.lit(""), F.lit(""), F.lit("A - 2011 - B.pdf"), 2024).alias("y3"),
    ).first()
    assert (row.a, row.b, row.c, row.y1, row.y2, row.y3) == (True, False, False, 1999, 2003, 2011)


def test_scores(spark):
    now = F.lit("2026-09-28 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        scoring.recency(F.lit(None).cast("timestamp"), now).alias("none"), scoring.recency(now - F.expr("interval 2000 days"), now).alias("old"), scoring.recency(now + F.expr("interval 5 days"), now).alias("future"),
        scoring.importance(F.lit(None).cast("int"), F.lit(""), F.lit("")).alias("blank"), scoring.importance(F.lit(100000), F.lit("Nature"), F.lit("")).alias("full"),
        scoring.is_famous(F.lit(None).cast("int")).alias("famous"), scoring.bar(F.lit(0.25)).alias("bar"),
    ).first()
    assert (row.none, row.old, row.future, row.blank, row.full, row.famous) == (0.3, 0.0, 1.0, 0.0, 1.0, False)
    assert row.bar == "██" + "░" * 8


def test_entities_are_resolved_as_in_a_browser(spark):
    import html
    import random
    from html.entities import html5

    r = random.Random(1)
    odd = ["#233;", "#xE9", "#x27;", "#0;", "#128;", "#x99;", "#xFEFF;", "#xD800;", "#1114112;", "#99999999999999999999;", "#x1F600;", "#11;", "#13;", "#xFFFE;", "#127;", "#", "#x", "", "amp;lt;", "notit;", "lt", "ltx", " ", "é", "ampersand"]
    texts = ["".join(r.choice(("&", "&", " ", "x", ";")) + r.choice(odd + list(html5)) for _ in range(r.randint(0, 6))) for _ in range(2000)]
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string").select("t", text.unescape(F.col("t")).alias("u"))
    assert [(x.t, x.u) for x in df.collect()] == [*((t, html.unescape(t)) for t in texts), (None, None)]
