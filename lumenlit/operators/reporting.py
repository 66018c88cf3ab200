"""Reports as text: written from a small ranked result, and parsed back at scale."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions import scoring
from lumenlit.functions.text import markdown_cell, plain_title, truncate
from lumenlit.operators import ranges, ranking

# Headings and marks of the report format.
HEADER = "| # | 论文 | 提交日期 | 相关性 | 时效性 | 重要性 | 总分 | 引用 | 标记 |"
RULE = "| ---: | --- | --- | ---: | ---: | ---: | ---: | ---: | --- |"
TITLE, STAMPED = "# arXiv 相关文献推荐报告", "> 由你的本地文献库自动分析生成 · 生成时间 %s"
SECTIONS = ("## 一、本次运行概览", "## 二、识别出的研究画像", "## 三、推荐总览", "## 四、逐篇详解", "## 附录")
WEIGHING = "评分 = 相关性 ×%.2f + 时效性 ×%.2f + 重要程度 ×%.2f"
STATS = (
    ("library_total", "文献库总量", "%d 篇"), ("with_text", "其中有摘要 / 全文", "%s 篇"), ("queries_used", "使用的检索式", "%d 条"), ("candidates_raw", "抓取候选论文", "%d 篇"), ("candidates_after_dedup", "排除库中已有后", "%d 篇"),
    ("candidates_enriched", "获得引用数据", "%d 篇"), ("candidates_analyzed", "完成 AI 解读", "%d 篇"), ("elapsed_sec", "耗时", "%.1f 秒"),
)
STAMP = r"生成时间\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
FLAG_WORDS = {"🆕新": "新", "⭐经典": "经典", "📖已发表": "已发表"}
FILE_NAME = r"recommend_(\d{8})_(\d{6})(?:_(.*))?\.md$"
#: Removed papers and other candidates that the appendix lists.
REMOVED, OTHERS = 60, 15


def table_rows(ranked: DataFrame, as_of: Column) -> DataFrame:
    """``rank`` and ``line``: the table of a report; absent citations show as a dash."""
    number = lambda c, f: F.format_string(f, F.col(c))
    title = F.concat(F.lit("["), truncate(markdown_cell(plain_title(F.col("title"))), 78), F.lit("]("), F.col("url"), F.lit(")"))
    cells = [F.col("rank").cast("string"), title, F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("—")), number("relevance", "%.2f"), number("recency", "%.2f"), number("importance", "%.2f"), F.concat(F.lit("**"), number("score", "%.3f"), F.lit("**")), F.coalesce(F.col("citations").cast("string"), F.lit("—")), scoring.flags(F.col("published"), F.col("citations"), F.col("journal_ref"), as_of)]
    return ranked.select("rank", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def detail_rows(ranked: DataFrame) -> DataFrame:
    """``rank``, ``n``, ``line``: the details of each paper; what it lacks leaves no line."""
    text = lambda c: F.coalesce(_given(ranked, c, "string"), F.lit(""))
    named = lambda head, value: F.when(value != "", F.concat(F.lit(f"**{head}**: "), value))
    updated = F.date_format(_given(ranked, "updated", "timestamp_ntz"), "yyyy-MM-dd")
    published = F.date_format("published", "yyyy-MM-dd")
    categories = F.array_join(F.slice(_given(ranked, "categories", "array<string>"), 1, 5), ", ")
    authors = truncate(F.coalesce(F.array_join(_given(ranked, "authors", "array<string>"), ", "), F.lit("")), 200, " 等")
    meta = F.filter(
        F.array(
            named("作者", authors), F.concat(F.lit("**提交**: "), F.coalesce(published, F.lit("—"))), F.when(updated != published, F.concat(F.lit("**最近更新**: "), updated)), named("分类", F.coalesce(categories, F.lit(""))),
            named("期刊", truncate(plain_title(text("journal_ref")), 120, "")), named("备注", truncate(plain_title(text("comments")), 160, "")), F.concat(F.lit("**引用数**: "), F.col("citations").cast("string")),
        ),
        lambda x: x.isNotNull(),
    )
    score = lambda head, c: F.concat(F.lit(head), F.format_string("%.2f  ", F.col(c)), scoring.bar(F.col(c)))
    explained = text("summary") != ""
    original = F.concat(F.lit("> "), F.replace(truncate(F.coalesce(F.nullif(text("abstract"), F.lit("")), F.lit("（无摘要）")), 900, ""), F.lit("\n"), F.lit(" ")))
    lines = F.flatten(
        F.array(
            F.array(F.lit("---"), F.lit(""), F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), plain_title(F.col("title"))), F.lit("")),
            F.array(F.concat(F.lit("**arXiv**: ["), F.col("arxiv_id"), F.lit("]("), F.col("url"), F.lit(") · **PDF**: [下载]("), F.replace(F.col("url"), F.lit("/abs/"), F.lit("/pdf/")), F.lit(")")), F.lit("")),
            F.array(F.array_join(F.slice(meta, 1, 3), " · "), F.lit("")),
            F.flatten(F.transform(F.slice(meta, F.lit(4), F.greatest(F.size(meta) - 3, F.lit(0))), lambda m: F.array(m, F.lit("")))),
            F.array(F.lit("**评分**"), F.lit(""), F.lit("```"), score("相关性   ", "relevance"), score("时效性   ", "recency"), score("重要程度 ", "importance"), F.concat(F.lit("综合得分 "), F.format_string("%.3f", "score")), F.lit("```"), F.lit("")),
            F.when(text("relevance_reason") != "", F.array(F.concat(F.lit("*相关性判断依据: "), text("relevance_reason"), F.lit("*")), F.lit(""))).otherwise(F.array().cast("array<string>")),
            F.array(F.lit("#### 📄 内容讲解"), F.lit("")),
            F.when(explained, F.array(text("summary"), F.lit(""))).otherwise(F.array(F.lit("> 未生成 (未配置 AI, 或该篇解读失败)。以下是原始摘要:"), F.lit(""), original, F.lit(""))),
            F.when(text("ideas") != "", F.array(F.lit("#### 💡 可以结合的研究方向"), F.lit(""), text("ideas"), F.lit(""))).otherwise(F.array().cast("array<string>")),
            F.when(explained & (text("abstract") != ""), F.array(F.lit("<details><summary>展开原始摘要</summary>"), F.lit(""), plain_title(text("abstract")), F.lit(""), F.lit("</details>"), F.lit(""))).otherwise(F.array().cast("array<string>")),
        )
    )
    return ranked.select("rank", F.posexplode(lines).alias("n", "line"))


def run_stats(candidates: DataFrame, floor: float, as_of: Column) -> DataFrame:
    """One row: candidates, those above the floor of relevance, famous ones, fresh ones and the best score."""
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("relevance") >= floor).alias("above_floor"), F.count_if(scoring.is_famous(F.col("citations"))).alias("famous"), F.count_if(scoring.is_new(F.col("published"), as_of)).alias("fresh"), F.max("score").alias("best"))


def report_lines(ranked: DataFrame, as_of: Column, stamp: str, stats: Mapping[str, Any], profile: Mapping[str, Any], candidates: DataFrame, removed: DataFrame | None = None, weights: tuple[float, float, float] = scoring.WEIGHTS) -> DataFrame:
    """A whole report as ``part``, ``rank``, ``n``, ``line``, to be read in that order.

    ``ranked`` is the top-N with ``rank`` and ``url``; ``candidates`` all that were scored;
    ``removed`` has ``title`` and ``reason``. Only the appendix is cut, to its fixed lengths.
    """
    spark = ranked.sparkSession
    head = [TITLE, "", STAMPED % stamp, "", SECTIONS[0], "", "| 项目 | 数值 |", "| --- | --- |", *(f"| {name} | {form % stats[key]} |" for key, name, form in STATS if key in stats), ""]
    if stats.get("ai_calls"):
        head += ["| AI 调用 / tokens | %d 次 / %d |" % (stats["ai_calls"], stats.get("ai_tokens", 0)), ""]
    head += [SECTIONS[1], ""]
    if profile.get("summary"):
        head += [profile["summary"], ""]
    for key, name, mark, most in (("topics", "主要研究主题", "、", 15), ("methods", "常用方法", "、", 12), ("keywords", "关键词", ", ", 35)):
        if profile.get(key):
            head += [f"**{name}**: " + mark.join(profile[key][:most]), ""]
    head += ["<sub>画像来源: %s</sub>" % profile.get("generated_by", ""), "", SECTIONS[2], "", WEIGHING % weights, "", HEADER, RULE]
    fixed = [(0, 0, i, t) for i, t in enumerate(head)] + [(2, 0, i, t) for i, t in enumerate(["", SECTIONS[3], ""])]
    fixed += [(4, 0, i, t) for i, t in enumerate(["---", "", SECTIONS[4], "", "### 使用的检索式", "", *(f"- `{q}`" for q in profile.get("queries", [])), ""])]
    part = lambda df, k: df.select(F.lit(k).alias("part"), F.col("rank").cast("int"), F.col("n").cast("int"), "line")
    out = part(table_rows(ranked, as_of).withColumn("n", F.lit(0)), 1).unionByName(part(detail_rows(ranked), 3))
    if removed is not None:
        shown = ranking.removed_list(removed, "title", REMOVED).withColumn("n", F.row_number().over(Window.orderBy("title")))
        title = truncate(plain_title(F.col("title")), 90)
        lines = shown.select(F.col("n").alias("rank"), F.lit(0).alias("n"), F.concat(F.lit("- "), title, F.lit(" — *"), "reason", F.lit("*")).alias("line"))
        count = removed.agg(F.count(F.lit(1)).alias("all")).where("all > 0")
        told = count.select(F.lit(0).alias("rank"), F.posexplode(F.array(F.concat(F.lit("### 已排除的库内文献 ("), F.col("all").cast("string"), F.lit(" 篇)")), F.lit(""), F.lit("这些论文已经在你的文献库里, 因此不再推荐:"), F.lit(""))).alias("n", "line"))
        more = count.where(F.col("all") > REMOVED).select(F.lit(REMOVED + 1).alias("rank"), F.lit(0).alias("n"), F.concat(F.lit("- … 另有 "), (F.col("all") - REMOVED).cast("string"), F.lit(" 篇")).alias("line"))
        for df in (told, lines, more):
            out = out.unionByName(part(df, 5))
    rest = ranking.rest_of(candidates, ranked, n=OTHERS).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")))
    link = F.concat(F.lit("- ["), truncate(plain_title(F.col("title")), 80), F.lit("]("), "url", F.lit(") — 相关性 "), F.format_string("%.2f", "relevance"), F.lit(" · "), F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("—")), F.lit(" · "), scoring.flags(F.col("published"), F.col("citations"), F.col("journal_ref"), as_of))
    out = out.unionByName(part(rest.select("rank", F.lit(0).alias("n"), link.alias("line")), 7))
    fixed += [(6, 0, i, t) for i, t in enumerate(["", "### 其他值得一看的候选 (按相关性)", ""])]
    return out.unionByName(spark.createDataFrame(fixed, "part int, rank int, n int, line string"))


def write_markdown(lines: DataFrame, path: str) -> None:
    """A report's lines as one text file, in order; a report is as long as its top-N."""
    ordered = lines.repartition(1).sortWithinPartitions("part", "rank", "n")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_json(ranked: DataFrame, stamp: str, stats: Mapping[str, Any], profile: Mapping[str, Any], path: str) -> None:
    """The same as one JSON document: time, counters, profile and the recommendations in order."""
    fields = F.struct("rank", *(c for c in ranked.columns if c != "rank"))
    told = ranked.agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("r"))  # the top-N
    head = json.dumps({"generated_at": stamp, "stats": dict(stats), "profile": dict(profile)}, ensure_ascii=False, default=str)
    told.select(F.concat(F.lit(head[:-1] + ', "recommendations": '), "r", F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_report(formats: Sequence[str], folder: str, stamp: str, tag: str, lines: DataFrame, ranked: DataFrame, stats: Mapping[str, Any], profile: Mapping[str, Any]) -> list[str]:
    """The wanted forms of a report (markdown, json) under names with its time and tag; what was written."""
    name = f"{folder}/arxiv_recommend_{stamp[:10].replace('-', '')}_{stamp[11:19].replace(':', '')}" + (f"_{tag}" if tag else "")
    written, wanted = [], {f.lower() for f in formats or ["markdown"]}
    if wanted & {"markdown", "md"}:
        write_markdown(lines, f"{name}.md")
        written.append(f"{name}.md")
    if "json" in wanted:
        write_json(ranked, stamp, stats, profile, f"{name}.json")
        written.append(f"{name}.json")
    return written


def parse_reports(reports: DataFrame, text: str = "text", key: str = "report") -> DataFrame:
    """Items of many reports: a row for each table line; malformed reports give none.

    Details ("### 1. title" and "**key**: value" pairs below it) win over the table for the date.
    """
    each = reports.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    row = each.where(F.col("line").rlike(r"^\|\s*\d+\s*\|"))
    cell = F.transform(F.split(F.regexp_replace(F.regexp_replace("line", r"^\|\s*|\s*\|\s*$", ""), r"\\\|", "\u0001"), r"\s*\|\s*"), lambda x: F.replace(x, F.lit("\u0001"), F.lit("|")))
    cells = row.select(key, cell.alias("c")).where(F.size("c") >= 9)
    none = lambda i: F.nullif(F.get("c", i), F.lit("—"))
    flags = F.array_join(F.transform(F.split(F.coalesce(none(8), F.lit("")), " "), lambda f: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in FLAG_WORDS.items() for x in p]), f), f)), " ")
    items = cells.select(
        key,
        F.get("c", 0).cast("int").alias("rank"),
        F.regexp_extract(F.get("c", 1), r"\[(.*?)\]\((https?://[^)]+)\)", 1).alias("title"),
        F.regexp_extract(F.get("c", 1), r"\[(.*?)\]\((https?://[^)]+)\)", 2).alias("url"),
        none(2).alias("date"),
        F.regexp_replace(F.get("c", 6), r"\*", "").try_cast("double").alias("score"),
        none(7).try_cast("int").alias("citations"),
        flags.alias("flags"),
    )
    details = reports.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^### \d+\.[^\n]*(?:\n(?!#)[^\n]*)*"), F.lit(0))).alias("d"))
    pair = lambda name: F.nullif(F.trim(F.regexp_extract("d", rf"\*\*{name}\*\*\s*[:：]\s*(.*?)(?:\s+·\s+(?=\*\*)|\n|$)", 1)), F.lit(""))
    details = details.select(key, F.regexp_extract("d", r"^### (\d+)\.", 1).cast("int").alias("rank"), pair("作者").alias("authors"), pair("提交").alias("submitted"), pair("期刊").alias("journal"), F.filter(F.transform(F.split(F.coalesce(pair("分类"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("categories"))
    return items.join(details.dropDuplicates([key, "rank"]), [key, "rank"], "left").withColumn("date", F.coalesce("submitted", "date")).drop("submitted")


def run_label(path: Column, generated_at: Column, items: Column) -> Column:
    """Time, number of papers and tag of a run; the time falls back to the file's name."""
    day, clock, tag = (F.regexp_extract(path, FILE_NAME, i) for i in (1, 2, 3))
    named = F.date_format(F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws(" · ", F.coalesce(F.nullif(generated_at, F.lit("")), named), F.concat(items.cast("string"), F.lit(" 篇")), F.nullif(tag, F.lit("")))


def library_summary(library: DataFrame) -> DataFrame:
    """Counts of rows with each kind of content, and the range of years."""
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return library.agg(F.count(F.lit(1)).alias("papers"), has("abstract").alias("with_abstract"), has("arxiv_id").alias("with_arxiv_id"), has("doi").alias("with_doi"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def ordinals(df: DataFrame, label: str, order: str) -> DataFrame:
    """Labels made unique: the second of a kind gets ``#2``, the third ``#3``; a label of any number of rows is numbered by ranges."""
    n = F.col("number")
    counted = ranges.numbered(df, [label], [order])
    return counted.withColumn("unique_label", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" #"), n.cast("string")))).drop("number")


#: Known labels in an automaton, and letters of the pieces by which labels inside known ones are found.
LABELS, PIECE = 200_000, 4


def _longest_inside(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``label``, ``known``: the longest known label that a label contains.

    Known labels are cut into blocks, each of which a task makes into an Aho-Corasick
    automaton; labels are streamed past every block and read once there, whatever it holds.
    """
    blocks = max(1, -(-known.count() // LABELS))
    held = known.select(F.pmod(F.xxhash64("known"), F.lit(blocks)).alias("block"), F.lit(0).alias("asked"), F.col("known").alias("text"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    # A block and its share of the labels is one group; the labels of few blocks are dealt out, with the block to each share.
    shares = max(1, asked.sparkSession.sparkContext.defaultParallelism // blocks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share")
    met = held.select("block", every, "asked", "text").unionByName(asked.select(each, F.pmod(F.xxhash64("label"), F.lit(shares)).alias("share"), F.lit(1).alias("asked"), F.col("label").alias("text")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, automaton = None, None
        for batch in batches:
            labels, found = [], []
            for *place, asked, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now:
                    now, automaton = place, ahocorasick.Automaton(ahocorasick.STORE_ANY)
                if not asked:
                    automaton.add_word(text, text)
                    continue
                if automaton.kind == ahocorasick.TRIE:
                    automaton.make_automaton()
                inside = max(((len(k), k) for _, k in automaton.iter(text)), default=None) if automaton.kind == ahocorasick.AHOCORASICK else None
                if inside:
                    labels.append(text)
                    found.append(inside[1])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(found, pa.string())], ["label", "known"])

    return met.repartition("block", "share").sortWithinPartitions("block", "share", "asked").mapInArrow(search, "label string, known string")


def _longest_around(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``label``, ``known``: the longest known label that a label lies in.

    Known labels are indexed by their pieces of up to ``PIECE`` letters. A label that short
    is a piece itself, whose longest known label is an aggregate; a longer one meets the
    known labels that have the rarest of its pieces, and none if one of them has no known label.
    """
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    whole = known.select("known", F.explode(pieces(F.col("known"), PIECE)).alias("piece"))
    short = known.select("known", F.explode(F.array_distinct(F.flatten(F.array(*(pieces(F.col("known"), n) for n in range(1, PIECE)))))).alias("piece"))
    longest = whole.unionByName(short).groupBy("piece").agg(F.max_by("known", F.struct(F.length("known"), "known")).alias("known"))
    few = asked.where(F.length("label") <= PIECE).join(longest, F.col("label") == F.col("piece")).select("label", "known")
    counts = whole.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = asked.where(F.length("label") > PIECE).select("label", F.explode(pieces(F.col("label"), PIECE)).alias("piece")).join(counts, "piece", "left")
    rarest = own.groupBy("label").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least")).where("least.n > 0").select("label", F.col("least.piece").alias("piece"))
    met = rarest.join(whole, "piece").where(F.contains("known", "label"))
    return few.unionByName(met.groupBy("label").agg(F.max_by("known", F.struct(F.length("known"), "known")).alias("known")))


def repaired_labels(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations (``id``, ``label``) whose label is known, or contains or lies in a known one (the longest wins)."""
    known = labels.select(F.col("label").alias("known")).where("known <> ''").distinct()
    asked = relations.where("label <> ''").select("label").distinct()
    a, b = F.col("label"), F.col("known")
    best = F.max_by("known", F.struct((a == b).alias("same"), F.length(b).alias("n"), b.alias("k")))
    found = _longest_inside(asked, known).unionByName(_longest_around(asked, known)).groupBy("label").agg(best.alias("known"))
    return relations.join(found, "label").select("id", "label", "known", *(c for c in relations.columns if c not in ("id", "label")))
