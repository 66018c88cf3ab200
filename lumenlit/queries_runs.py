"""Registered queries of feeds, history, conversations, index, profile and reports; SQL in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.functions import scoring, text
from lumenlit.operators import linkage, merging, ranges, ranking, reporting, state, tfidf
from lumenlit.plans import profile, recommend, search
from lumenlit.queries import _HISTORY, _PAPERS, _PLAIN, AS_OF, STOP, VENUES, _contents, _files, _FILES, _PLAN, _history, _now, _profile, _scored, age_sql, candidates, library, norm_sql, papers, query, table
from lumenlit.sources import feeds, files

# --- feeds ----------------------------------------------------------------------------


def _xml(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_ONE_LINE = "trim(regexp_replace(replace(replace({c}, chr(160), ' '), chr(8203), ''), '\\s+', ' ', 'g'))"


def _line(c: str) -> str:
    return _ONE_LINE.format(c=c)


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without control characters, which XML can't hold."""
    return papers(spark, sf_dir).withColumn("title", F.regexp_replace("title", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


_TITLE = r"regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query(f"WITH {_PAPERS} SELECT CASE id % 7 WHEN 0 THEN 'q0' ELSE 'q1' END AS query, lower(arxiv_id) AS arxiv_id, 'v' || (id % 3 + 1) AS version, {_line(_TITLE)} AS title, published, category AS primary_category, category || '|' || source AS categories FROM papers WHERE arxiv_id <> '' AND {_line(_TITLE)} <> ''")
def parse_atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _plain(spark, sf_dir)
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), "arxiv_id", F.lit("v"), (F.col("id") % 3 + 1).cast("string"), F.lit("</id><title>"), _xml("title"), F.lit("</title><summary>s</summary>"),
        F.coalesce(F.concat(F.lit("<published>"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>")), F.lit("")),
        F.lit('<arxiv:primary_category term="'), "category", F.lit('"/><category term="'), "category", F.lit('"/><category term="'), "source", F.lit('"/></entry>'),
    )
    feed = df.select(F.when(F.col("id") % 7 == 0, "q0").otherwise("q1").alias("query"), F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="a">'), entry, F.lit("</feed>")).alias("xml"))
    return feeds.parse_atom(feed).select("query", "arxiv_id", "version", "title", "published", "primary_category", F.array_join("categories", "|").alias("categories"))


def _rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _plain(spark, sf_dir).where("arxiv_id <> ''")
    item = F.concat(
        F.lit("<item><title>"), _xml("title"), F.lit("</title><link>https://arxiv.org/abs/"), "arxiv_id", F.lit("</link><description>arXiv:1 Announce Type: new Abstract: of "), "source", F.lit(" caf&amp;eacute; &amp;ndash; &amp;#233; &amp;#x27;q&amp;#x27; &amp;notit; &amp;amp;lt; &amp;unknown;"),
        F.lit("</description><category>"), "category", F.lit("</category><pubDate>"), F.coalesce(F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss"), F.lit("never")),
        F.lit(" -0500</pubDate><arxiv:announce_type>"), F.element_at(F.array(*map(F.lit, ("new", "cross", "replace", "new"))), (F.col("id") % 4 + 1).cast("int")), F.lit("</arxiv:announce_type><dc:creator>A B</dc:creator></item>"),
    )
    return df.select(F.concat(F.lit("cat"), F.col("id").cast("string")).alias("category"), F.concat(F.lit('<rss xmlns:arxiv="a" xmlns:dc="d"><channel>'), item, F.when(F.col("id") % 11 != 3, F.lit("</channel></rss>")).otherwise("")).alias("xml"))


_ITEMS = f"WITH {_PAPERS}, r AS (SELECT *, CASE id % 4 WHEN 1 THEN 'cross' WHEN 2 THEN 'replace' ELSE 'new' END AS kind FROM papers WHERE arxiv_id <> '' AND id % 11 <> 3 AND {_line(_TITLE)} <> '')"


@query(f"{_ITEMS} SELECT lower(arxiv_id) AS arxiv_id, 'cat' || id AS feed, {_line(_TITLE)} AS title, 'of ' || source || ' café – é ''q'' ¬it; &lt; &unknown;' AS abstract, published, kind AS announce_type, 'cat' || id || '|' || category AS categories FROM r WHERE kind IN ('new', 'cross')")
def parse_rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = F.regexp_extract("query", r"^<RSS> (.*) 最新公告$", 1)
    return feeds.parse_rss(_rss(spark, sf_dir)).select("arxiv_id", feed.alias("feed"), "title", "abstract", "published", "announce_type", F.array_join("categories", "|").alias("categories"))


_FEEDS = f"{_ITEMS}, placed AS (SELECT 'f' || id % 40 AS feed, lower(arxiv_id) AS arxiv_id, min((id // 40) % 3) AS place FROM r WHERE kind IN ('new', 'cross') GROUP BY ALL)"


@query(f"{_FEEDS} SELECT feed, arxiv_id, place FROM placed QUALIFY row_number() OVER (PARTITION BY feed ORDER BY place, arxiv_id) <= 5")
def scan_rss_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty categories of many feeds each, whose items stand at one of three places; five papers of each category."""
    failed = spark.createDataFrame([("catX", None), ("", "<rss/>"), ("catX", "<rss><channel><item>")], "category string, xml string")
    i = F.regexp_extract("category", r"(\d+)$", 1).cast("long")
    blank = F.repeat(F.lit("<item><title>none</title></item>"), (F.floor(i / 40) % 3).cast("int"))
    rows = _rss(spark, sf_dir).select(F.concat(F.lit(" f"), (i % 40).cast("string"), F.lit(" ")).alias("category"), F.replace("xml", F.lit("<channel>"), F.concat(F.lit("<channel>"), blank)).alias("xml"))
    return feeds.scan_feeds(rows.unionByName(failed), 5).select("feed", "arxiv_id", F.col("place").cast("long").alias("place"))


# --- candidates and scores --------------------------------------------------------------

_JUDGED = "CASE WHEN id % 3 = 0 THEN round((id * 31 % 100) / 100.0, 4) END"


@query(f"WITH {_PLAIN} SELECT id, coalesce({_JUDGED}, relevance, 0.0) AS relevance, CASE WHEN id % 3 = 0 THEN 'r' || id % 5 ELSE '{scoring.HEURISTIC_REASON}' END AS reason FROM final")
def judged_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = F.when(F.col("id") % 3 == 0, F.round((F.col("id") * 31 % 100) / 100.0, 4))
    relevance, reason = scoring.chosen_relevance(judge, F.concat(F.lit("r"), (F.col("id") % 5).cast("string")), F.col("relevance"))
    return _scored(spark, sf_dir).select("id", relevance.alias("relevance"), reason.alias("reason"))


@query(f"WITH {_PLAIN} SELECT id, relevance FROM final ORDER BY relevance DESC, id LIMIT 300")
def prefilter_for_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.most_relevant(_scored(spark, sf_dir), 300).select("id", "relevance")


@query(f"WITH {_PLAIN}, a AS (SELECT id FROM final ORDER BY relevance DESC, id LIMIT 400) SELECT f.id, CASE WHEN a.id IS NOT NULL THEN CAST(w.quality * (w.doc_id % 300) AS INT) END AS citations, a.id IS NOT NULL AND w.doc_id IS NOT NULL AS enriched FROM final f LEFT JOIN a USING (id) LEFT JOIN labels w ON f.doi = '10.1000/x' || w.doc_id")
def enrich_most_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scored(spark, sf_dir)
    asked = ranking.most_relevant(df, 400).select("id", F.lit(True).alias("asked"))
    works = table(spark, sf_dir, "labels").select(F.concat(F.lit("10.1000/x"), F.col("doc_id").cast("string")).alias("doi"), (F.col("quality") * (F.col("doc_id") % 300)).alias("cited_by"), F.lit("S").alias("source"), F.array().cast("array<struct<display_name: string, score: double>>").alias("concepts"))
    return merging.enrich(df.join(asked, "id", "left"), works, where=F.coalesce("asked", F.lit(False))).select("id", "citations", "enriched")


_LIST = f"concat_ws(' ', CASE WHEN id % 6 = 0 THEN '推荐' END, CASE WHEN id % 5 = 0 THEN (CASE WHEN id % 4 > 0 THEN '推荐 ' || (id % 4) || ' 次' ELSE '已推荐过' END) WHEN id % 5 = 1 THEN '已推荐过' END, CASE WHEN journal_ref <> '' THEN '已发表' END, CASE WHEN citations >= 50 THEN '经典' END, CASE WHEN {age_sql('published')} <= 180 THEN '新' END, CASE WHEN id % 8 = 0 THEN '复用解读' WHEN id % 8 < 4 THEN '已解读' END)"


@query(f"WITH {_PAPERS} SELECT id, {_LIST} AS flags FROM papers")
def list_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    told = scoring.list_flags(i % 6 == 0, i % 5 == 0, i % 5 == 1, i % 4, F.col("journal_ref"), F.col("citations"), F.col("published"), i % 8 < 4, i % 8 == 0, _now())
    return papers(spark, sf_dir).select("id", told.alias("flags"))


@query(f"WITH {_PAPERS}, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(published, CASE WHEN id % 34 = 0 THEN NULL ELSE TIMESTAMP '2023-06-01' END) ELSE published END AS d FROM papers) SELECT id, round(CASE WHEN d IS NULL THEN 0.3 WHEN {age_sql('d')} > 1460.0 THEN 0.0 ELSE exp(-{age_sql('d')} / 365.0) END, 6) AS recency FROM p")
def recency_of_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = F.when((F.col("id") % 3 == 0) & (F.col("id") % 34 != 0), F.lit("2023-06-01 00:00:00").cast("timestamp_ntz"))
    return papers(spark, sf_dir).select("id", F.round(scoring.recency(F.col("published"), _now(), updated=updated), 6).alias("recency"))


@query(f"WITH {_PAPERS}, r AS (SELECT id, title FROM papers WHERE id % 7 = 2) SELECT id, title, greatest((SELECT count(*) FROM r) - 60, 0) AS more FROM r ORDER BY id LIMIT 60")
def removed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.removed_list(papers(spark, sf_dir).where("id % 7 = 2").select("id", "title"), "id").select("id", "title", "more")


# --- linkage with more than exact keys ------------------------------------------------------


def _variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Library titles, and candidates that hold one of them: with more words, as the next part of a series, or of other identity."""
    own = recommend.with_keys(papers(spark, sf_dir)).where("id % 5 = 0").select("id", "arxiv_id", F.lit("").alias("doi"), "norm_title")
    tail = F.when(F.col("id") % 4 == 0, " and what else there is").when(F.col("id") % 4 == 1, " ii the next one").when(F.col("id") % 4 == 2, " seen again").otherwise(" part two")
    other = own.select((F.col("id") + 1_000_000_000).alias("id"), F.when(F.col("id") % 3 == 0, "9901.00001").otherwise("").alias("arxiv_id"), "doi", F.concat("norm_title", tail).alias("norm_title"))
    return other, own


_VARIANTS = rf"""{_PAPERS}, own AS (SELECT id, arxiv_id, {norm_sql('title')} AS nt FROM papers WHERE id % 5 = 0),
oth AS (SELECT id + 1000000000 AS id, CASE WHEN id % 3 = 0 THEN '9901.00001' ELSE '' END AS arxiv_id, nt || CASE id % 4 WHEN 0 THEN ' and what else there is' WHEN 1 THEN ' ii the next one' WHEN 2 THEN ' seen again' ELSE ' part two' END AS nt FROM own),
w AS (SELECT 1 AS side, id, unnest(string_split(nt, ' ')) AS t FROM oth UNION ALL SELECT 2, id, unnest(string_split(nt, ' ')) FROM own), s AS (SELECT DISTINCT a.id AS a, b.id AS b FROM w a JOIN w b ON a.side = 1 AND b.side = 2 AND a.t = b.t AND length(a.t) >= 5),
p AS (SELECT a, b, CASE WHEN length(x.nt) <= length(y.nt) THEN x.nt ELSE y.nt END AS short, CASE WHEN length(x.nt) <= length(y.nt) THEN y.nt ELSE x.nt END AS long FROM s JOIN oth x ON s.a = x.id JOIN own y ON s.b = y.id WHERE NOT (x.arxiv_id <> '' AND y.arxiv_id <> '' AND lower(x.arxiv_id) <> lower(y.arxiv_id)))"""


@query(rf"WITH {_VARIANTS} SELECT a, b FROM p WHERE length(short) >= 40 AND contains(long, short) AND NOT regexp_matches(substr(long, instr(long, short) + length(short)), '(?i)^[\s.,;:—\-–]*(?:[IVXL]{{1,6}}\.?(?:[\s:.—\-–]|$)|\d{{1,2}}\.?(?:[\s:.—\-–]|$)|part\b|pt\.?\b)')")
def contained_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.fuzzy_pairs(*_variants(spark, sf_dir), similar=False).select("a", "b")


@query()
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fuzzy pairs of the same titles, with the rule and the ratio: pairs of classes of equal rows, and rule 0 for a row and its class."""
    return linkage.class_pairs(*_variants(spark, sf_dir))


@query()
def flagship_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendation with its default steps, over all candidates: similar titles, pairs of words, history, citations and a judge."""
    seen = state.replay(_history(spark, sf_dir)).withColumn("arxiv_id", F.col("arxiv_id").cast("string"))
    works = table(spark, sf_dir, "labels").select(F.concat(F.lit("10.1000/x"), F.col("doc_id").cast("string")).alias("doi"), (F.col("quality") * (F.col("doc_id") % 300)).alias("cited_by"), F.lit("src7 letters").alias("source"), F.array().cast("array<struct<display_name: string, score: double>>").alias("concepts"))
    judged = table(spark, sf_dir, "labels").where("doc_id % 10 = 1").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.9).cast("double").alias("score"), F.lit("label").alias("reason"))
    options = recommend.Options(as_of=AS_OF, candidate_cap=0, enriched_cap=0, venues=VENUES, stop_words=STOP, min_relevance=0.05)
    run = recommend.Recommendation(candidates(spark, sf_dir), library(spark, sf_dir), _profile(spark, sf_dir), options, seen, works, judged)
    return run.plan("top").select("id", "title", "relevance", "relevance_reason", "recency", "importance", "score", "citations", "seen_before")


@query()
def self_dedup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.self_components(library(spark, sf_dir))


@query()
def library_anti_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.not_in_library(candidates(spark, sf_dir), library(spark, sf_dir)).select("id")


# --- history, conversations, index ----------------------------------------------------------


@query(f"WITH {_HISTORY} SELECT count(*) AS total, count(*) FILTER (analyzed) AS analyzed, max(last_at) AS last_run FROM hist")
def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history_totals(state.replay(_history(spark, sf_dir)))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history whose rows lack this or that."""
    i = F.col("arxiv_id")
    blank = lambda c, n: F.when(i % n == 0, "").otherwise(F.concat(F.lit(f"{c}-"), i.cast("string"))).alias(c)
    return state.replay(_history(spark, sf_dir)).select("*", blank("authors", 3), blank("published", 4), blank("journal", 2), blank("categories", 5), blank("title", 7), F.when(i % 6 != 0, i % 50).cast("int").alias("citations"), blank("ideas", 8), F.when(i % 2 == 0, "fp").otherwise("").alias("profile_fp"))


_BLANKS = {"authors": 3, "published": 4, "journal": 2, "categories": 5, "title": 7, "ideas": 8}
_KEPT = _HISTORY + ", kept AS (SELECT *, " + ", ".join(f"CASE WHEN arxiv_id % {n} = 0 THEN '' ELSE '{c}-' || arxiv_id END AS {c}" for c, n in _BLANKS.items()) + ", CASE WHEN arxiv_id % 6 <> 0 THEN CAST(arxiv_id % 50 AS INT) END AS citations, CASE WHEN arxiv_id % 2 = 0 THEN 'fp' ELSE '' END AS profile_fp FROM hist)"


@query(f"WITH {_KEPT} SELECT arxiv_id FROM kept WHERE authors = '' OR published = ''")
def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.missing_metadata(_kept(spark, sf_dir)).select("arxiv_id")


@query(f"WITH {_KEPT}, m AS (SELECT *, (authors = '' OR published = '') AND arxiv_id % 5 <> 1 AS hit FROM kept) SELECT arxiv_id, title, CASE WHEN hit THEN 'A' || arxiv_id ELSE authors END AS authors, CASE WHEN hit THEN '2020' ELSE published END AS published, CASE WHEN hit THEN '' ELSE journal END AS journal, CASE WHEN hit THEN 'c' ELSE categories END AS categories, CASE WHEN hit THEN NULL ELSE citations END AS citations FROM m")
def repair_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    source = kept.where("arxiv_id % 5 <> 1").select("arxiv_id", F.concat(F.lit("A"), F.col("arxiv_id").cast("string")).alias("authors"), F.lit("2020").alias("published"), F.lit("").alias("journal"), F.lit("c").alias("categories"), F.lit(None).cast("int").alias("citations"))
    return state.repaired(kept, source).select("arxiv_id", "title", *state.REFRESHED)


@query(f"WITH {_KEPT}, e AS (SELECT CAST(c_custkey AS BIGINT) AS arxiv_id, 'why ' || c_custkey AS s FROM customer WHERE c_custkey % 9 < 4) SELECT coalesce(k.arxiv_id, e.arxiv_id) AS arxiv_id, coalesce(k.times, 1) AS times, CASE WHEN k.arxiv_id IS NULL THEN 'new' ELSE k.title END AS title, CASE WHEN e.arxiv_id IS NULL THEN k.summary ELSE e.s END AS summary, CASE WHEN e.arxiv_id IS NULL THEN k.ideas ELSE '' END AS ideas, coalesce(k.analyzed, false) OR e.arxiv_id IS NOT NULL AS analyzed, coalesce(k.best_score, 0.0) AS best_score, CASE WHEN k.arxiv_id IS NULL THEN TIMESTAMP '{AS_OF}' ELSE k.last_at END AS last_at FROM kept k FULL JOIN e ON k.arxiv_id = e.arxiv_id")
def save_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").where("c_custkey % 9 < 4").select(F.col("c_custkey").cast("long").alias("arxiv_id"), F.lit("new").alias("title"), F.lit("0").alias("report"), F.concat(F.lit("why "), F.col("c_custkey").cast("string")).alias("summary"), F.lit("").alias("ideas"), F.lit("fp2").alias("profile_fp"))
    return state.save_explanations(_kept(spark, sf_dir), new, _now()).select("arxiv_id", "times", "title", "summary", "ideas", "analyzed", "best_score", "last_at")


@query(f"WITH {_KEPT} SELECT arxiv_id, summary FROM kept WHERE analyzed AND trim(summary) <> '' AND profile_fp = 'fp' AND arxiv_id % 3 <> 1")
def reusable_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    return state.reusable(kept, kept.where("arxiv_id % 3 <> 1"), "fp").select("arxiv_id", "summary")


@query(f"WITH {_KEPT} SELECT arxiv_id, times FROM kept WHERE arxiv_id % 4 <> 2")
def forget_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    return state.forget(kept, kept.where("arxiv_id % 4 = 2")).select("arxiv_id", "times")


@query(f"WITH {_HISTORY} SELECT arxiv_id, times, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS INT) AS citations FROM hist")
def migrate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.migrate(state.replay(_history(spark, sf_dir)), _kept(spark, sf_dir)).select("arxiv_id", "times", "title", "citations")


@query(f"WITH {_KEPT}, i AS (SELECT c_custkey AS arxiv_id, n, 'B' || c_custkey || n AS authors, CASE WHEN n = 1 THEN '' ELSE '2021' END AS published, CAST(c_custkey % 7 AS VARCHAR) AS citations FROM customer, (SELECT unnest([1, 2]) AS n) WHERE c_custkey % 2 = 0 OR n = 2), f AS (SELECT arxiv_id, arg_min(authors, n) AS a, arg_min(published, n) AS p, arg_min(citations, n) AS c FROM i GROUP BY arxiv_id) SELECT k.arxiv_id, CASE WHEN authors <> '' THEN authors ELSE coalesce(a, '') END AS authors, CASE WHEN published <> '' THEN published ELSE coalesce(p, '') END AS published, coalesce(k.citations, CAST(c AS INT)) AS citations FROM kept k LEFT JOIN f ON k.arxiv_id = f.arxiv_id")
def history_from_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").withColumn("place", F.explode(F.array(F.lit(1), F.lit(2)))).where((i % 2 == 0) | (F.col("place") == 2))
    items = items.select(i.alias("arxiv_id"), "place", F.concat(F.lit("B"), i.cast("string"), F.col("place").cast("string")).alias("authors"), F.when(F.col("place") == 1, "").otherwise("2021").alias("published"), (i % 7).cast("string").alias("citations"), *(F.lit("").alias(c) for c in ("journal", "categories", "title")))
    return merging.history_with_reports(_kept(spark, sf_dir), items).select("arxiv_id", "authors", "published", "citations")


@query(f"WITH {_KEPT} SELECT c_custkey AS arxiv_id, coalesce(summary, '') AS summary, coalesce(ideas, '') AS ideas, coalesce(analyzed, false) AS analyzed, k.arxiv_id IS NOT NULL AS seen_before, coalesce(times, 0) AS seen_times, last_at AS last_recommended FROM customer c LEFT JOIN kept k ON k.arxiv_id = c_custkey")
def report_items_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.items_with_history(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("arxiv_id")), _kept(spark, sf_dir)).select("arxiv_id", "summary", "ideas", "analyzed", "seen_before", "seen_times", "last_recommended")


@query("WITH c AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations), n AS (SELECT conv_id, role, text, id + (SELECT max(id) FROM c WHERE turn < 3) AS id FROM c WHERE turn >= 3 AND trim(text) <> '') SELECT id, conv_id, role, md5(text) AS text_md5 FROM c WHERE turn < 3 UNION ALL SELECT id, conv_id, role, md5(text) FROM n")
def append_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ranges.numbered(table(spark, sf_dir, "conversations"), [], ["conv_id", "turn"]).select(F.col("number").alias("id"), "conv_id", "role", "text", "turn")
    old, new = turns.where("turn < 3").drop("turn"), turns.where("turn >= 3").drop("turn")
    return state.append_turns(old, new, "conv_id", "id", "text").select("id", "conv_id", "role", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def clear_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return state.clear_conversations(turns, turns.where("conv_id % 3 = 0"), "conv_id").select("conv_id", "turn")


@query(f"WITH {_PAPERS}, t AS (SELECT id AS path, category AS tags FROM papers WHERE id % 2 = 0), c AS (SELECT id AS path, CASE WHEN id % 9 = 0 THEN ' ' ELSE source END AS tags FROM papers WHERE id % 3 = 0) SELECT path, tags FROM t WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, tags FROM c WHERE trim(tags) <> ''")
def set_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = papers(spark, sf_dir)
    old = df.where("id % 2 = 0").select(F.col("id").alias("path"), F.col("category").alias("tags"))
    return state.set_tags(old, df.where("id % 3 = 0").select(F.col("id").alias("path"), F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("source")).alias("tags")))


@query(f"WITH {_FILES} SELECT sha1, last(path ORDER BY mtime, path) AS path FROM idx WHERE status = 'ok' AND sha1 IN (SELECT sha1 FROM listing) GROUP BY sha1")
def index_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, index = _files(spark, sf_dir)
    return state.newest_readable(index.withColumn("seen_at", F.col("mtime")), listing).select("sha1", "path")


@query(f"WITH {_FILES} SELECT path, status FROM idx WHERE path % 13 = 0")
def index_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _files(spark, sf_dir)
    return state.indexed_at(index, index.where("path % 13 = 0")).select("path", "status")


@query(f"WITH {_FILES} SELECT 'same' AS version, path FROM idx")
def rebuild_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of this version stays, one of another version is made anew from nothing."""
    _, index = _files(spark, sf_dir)
    versioned = index.withColumn("version", F.lit(3))
    same = state.current_index(versioned, 3).select(F.lit("same").alias("version"), "path")
    return same.unionByName(state.current_index(versioned, 4).select(F.lit("other").alias("version"), "path"))


@query(f"WITH {_PLAN} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ('reuse', 'move', 'deepen', 'parse', 'failed', 'missing'))} FROM plan")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.scan_stats(state.plan_scan(*_files(spark, sf_dir), "sections", _contents(spark, sf_dir)))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'asked' END AS value FROM customer")
def memo_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return files.memoised(keys.unionByName(keys), keys.where("key % 3 = 0").withColumn("value", F.lit("kept")), lambda rest: rest.withColumn("value", F.lit("asked")))


# --- profile and reports --------------------------------------------------------------------


@query("WITH e AS (SELECT event_id AS n, event_type AS v FROM events WHERE event_id % 50 = 0), f AS (SELECT lower(v) AS k, min(n) AS n, arg_min(v, n) AS v FROM e GROUP BY 1) SELECT string_agg(v, '|' ORDER BY n) AS topics, (SELECT string_agg(DISTINCT 'm' || (event_id % 3), '|' ORDER BY 'm' || (event_id % 3)) FROM events WHERE event_id % 50 = 0) AS methods FROM f")
def merge_group_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id % 50 = 0")
    none = F.array().cast("array<string>")
    groups = e.select(F.col("event_id").alias("n"), F.array(F.concat(F.lit(" "), "event_type"), "event_type").alias("topics"), F.array(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")), F.lit("")).alias("methods"), none.alias("keywords"), none.alias("subfields"))
    return profile.merged_groups(groups).select(F.array_join("topics", "|").alias("topics"), F.array_join(F.array_sort("methods"), "|").alias("methods"))


@query(f"WITH {_PAPERS} SELECT category, '研究方向概述: ' || category || chr(10) || '主要主题: ' || array_to_string(list_sort(list(DISTINCT source))[1:15], '、') || chr(10) || '关键词: k' AS digest FROM papers GROUP BY category")
def scoring_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = papers(spark, sf_dir).groupBy("category").agg(F.array_sort(F.collect_set("source")).alias("topics"))
    own = own.withColumns({"summary": F.col("category"), "methods": F.array().cast("array<string>"), "keywords": F.array(F.lit("k"))})
    return profile.scoring_digest(own).select("category", "digest")


@query(f"WITH {_PAPERS}, l AS (SELECT id, title || coalesce(' (' || year(published) || ')', '') || CASE WHEN journal_ref <> '' THEN ' [' || journal_ref || ']' ELSE '' END || CASE WHEN source <> '' THEN ' — ' || source ELSE '' END AS line FROM papers), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l) SELECT id, line FROM s WHERE b = 0 OR b + length(line) <= 40000")
def library_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = profile.paper_line(F.col("title"), F.year("published"), F.col("journal_ref"), F.col("source"))
    return profile.digest(papers(spark, sf_dir), line, ["id"]).select("id", "line")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of some papers each, one for each source, every third without its time."""
    rows = papers(spark, sf_dir).select("source", "id", F.concat(F.lit("| "), F.col("id").cast("string"), F.lit(" | [T"), F.col("id").cast("string"), F.lit("](https://arxiv.org/abs/x"), F.col("id").cast("string"), F.lit(") | 2024-01-02 | 0.5 | 0.5 | 0.5 | **0.500** | — | ⭐经典 |")).alias("line"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    body = rows.groupBy("source").agg(text_.alias("t"))
    stamp = F.when(n % 3 != 0, F.concat(F.lit("生成时间 2024-01-"), F.lpad((n + 1).cast("string"), 2, "0"), F.lit(" 10:00:00\n"))).otherwise("")
    return body.select(F.concat(F.lit("/o/arxiv_recommend_202301"), F.lpad((n + 1).cast("string"), 2, "0"), F.lit("_080000"), F.when(n % 2 == 0, "_tag").otherwise(""), F.when(n == 4, ".txt").otherwise(".md")).alias("report"), F.concat(stamp, "t").alias("text"))


@query("WITH r AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n, count(*) AS items FROM documents GROUP BY source), s AS (SELECT '/o/arxiv_recommend_202301' || lpad(CAST(n + 1 AS VARCHAR), 2, '0') || '_080000' || CASE WHEN n % 2 = 0 THEN '_tag' ELSE '' END || '.md' AS report, CASE WHEN n % 3 <> 0 THEN '2024-01-' || lpad(CAST(n + 1 AS VARCHAR), 2, '0') || ' 10:00:00' ELSE '' END AS generated_at, items, n FROM r WHERE n <> 4) SELECT report, generated_at, items, CASE WHEN generated_at <> '' THEN generated_at ELSE '2023-01-' || lpad(CAST(n + 1 AS VARCHAR), 2, '0') || ' 08:00:00' END || ' · ' || items || ' 篇' || CASE WHEN n % 2 = 0 THEN ' · tag' ELSE '' END AS label, CAST(row_number() OVER (ORDER BY generated_at DESC, report) AS INT) AS place FROM s")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    runs = _runs(spark, sf_dir)
    listed = files.list_runs(runs, reporting.parse_reports(runs))
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("generated_at"), "report")))


@query("SELECT '/o/arxiv_recommend_202301' || lpad(CAST(CAST(regexp_extract(source, '(\\d+)', 1) AS INT) + 1 AS VARCHAR), 2, '0') || '_080000' || CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 2 = 0 THEN '_tag' ELSE '' END || CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INT) = 4 THEN '.txt' ELSE '.md' END AS report, CAST(doc_id AS INT) AS rank FROM documents WHERE contains('t' || doc_id || ' ' || '经典 ' || doc_id, 't1')")
def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.run_search(reporting.parse_reports(_runs(spark, sf_dir)), " T1").select("report", "rank")


@query(f"WITH {_PAPERS} SELECT id, CASE WHEN n > 1 THEN source || ' #' || n ELSE source END AS label FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM papers)")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.ordinals(papers(spark, sf_dir), "source", "id").select("id", F.col("unique_label").alias("label"))


@query("WITH k AS (SELECT DISTINCT p_brand AS known FROM part), r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' extra' WHEN 2 THEN left(p_brand, length(p_brand) - 1) ELSE 'none' END AS label FROM part), j AS (SELECT id, label, known FROM r JOIN k ON label = known OR contains(label, known) OR contains(known, label)) SELECT id, label, known FROM j QUALIFY row_number() OVER (PARTITION BY id, label ORDER BY label = known DESC, length(known) DESC, known DESC) = 1")
def repair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    label = F.when(i % 4 == 0, F.col("p_brand")).when(i % 4 == 1, F.concat("p_brand", F.lit(" extra"))).when(i % 4 == 2, F.substring("p_brand", F.lit(1), F.length("p_brand") - 1)).otherwise("none")
    return reporting.repaired_labels(part.select(i.alias("id"), label.alias("label")), part.select(F.col("p_brand").alias("label"))).select("id", "label", "known")


@query(f"WITH {_PLAIN} SELECT id, CASE WHEN id % 3 = 0 THEN 'A 等' WHEN id % 3 = 1 THEN 'A' ELSE '—' END AS authors, coalesce(strftime(published, '%Y-%m-%d'), CASE WHEN id % 2 = 0 THEN '2020-02-03' ELSE '—' END) AS date, CASE WHEN journal_ref = '' THEN '—' ELSE journal_ref END AS journal, CASE WHEN id % 90 < 60 THEN printf('%.1fs', CAST(id % 90 AS DOUBLE)) ELSE '1m' || lpad(CAST(id % 90 - 60 AS VARCHAR), 2, '0') || 's' END AS took FROM final")
def shown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    authors = F.when(i % 3 == 0, F.array(F.lit("A"), F.lit(" "), F.lit("B"))).when(i % 3 == 1, F.array(F.lit(" A "))).otherwise(F.array().cast("array<string>"))
    updated = F.when(i % 2 == 0, F.lit("2020-02-03").cast("timestamp_ntz"))
    return papers(spark, sf_dir).select("id", text.author_line(authors).alias("authors"), text.shown_date(F.col("published"), updated).alias("date"), text.shown_journal(F.col("journal_ref")).alias("journal"), text.elapsed((i % 90).cast("double")).alias("took"))


@query(f"WITH {_PAPERS} SELECT id, trim(lower(concat_ws(' ', nullif(source, ''), nullif(journal_ref, ''), 'tag ' || category))) AS words FROM papers")
def library_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tfidf.library_text(F.col("source"), F.col("journal_ref"), F.lit(""), F.array(F.lit("tag"), F.col("category")))
    return papers(spark, sf_dir).select("id", words.alias("words"))


@query(f"WITH {_PAPERS}, {_HISTORY} SELECT user_id, min(ts) AS first_at, count(*) AS n FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id")
def announced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of the wanted types replayed into a history."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view"))
    events = e.select(F.col("user_id").alias("arxiv_id"), F.col("ts").alias("at"), F.col("value").alias("score"), F.col("event_id").alias("report"), F.lit(False).alias("analyzed"), F.lit("").alias("summary"))
    return state.replay(events).select(F.col("arxiv_id").alias("user_id"), "first_at", F.col("times").alias("n"))




@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'q ' || c_mktsegment END, c_name, 'one two three four five six', lower(c_mktsegment)], lambda x: x IS NOT NULL)[1:3], '|') AS queries FROM customer")
def profile_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of profiles whose lists hold long terms, repeats in other letters and terms without a Latin letter."""
    c = table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    profiles = c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("q "), "c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, none).alias("queries"),
        F.array("c_name", F.concat(F.lit(" one two  three four five six seven "), F.col("c_custkey").cast("string"))).alias("keywords"),
        F.array(F.lower("c_mktsegment"), F.lit("符号问题")).alias("methods"),
        F.array(F.lit("123"), F.col("c_mktsegment")).alias("topics"),
    )
    return profiles.select("c_custkey", F.array_join(profile.term_queries(profiles, 3), "|").alias("queries"))


@query("""SELECT c_custkey, left(sha1('{"k": ["' || c_name || '", "a \\"b\\" ' || c_custkey || '"], "m": [], "q": ' || CASE WHEN c_custkey % 3 = 0 THEN '["' || lower(c_mktsegment) || '"]' ELSE 'null' END || ', "s": "über ' || c_mktsegment || '", "t": ["' || c_mktsegment || '"]}'), 16) AS fingerprint FROM customer""")
def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment, none = F.col("c_mktsegment"), F.array().cast("array<string>")
    named = F.array("c_name", F.concat(F.lit('a "b" '), F.col("c_custkey").cast("string")))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lower(segment)))
    return c.select("c_custkey", state.fingerprint_of(asked, F.array(segment), none, named, F.concat(F.lit("über "), segment)).alias("fingerprint"))
