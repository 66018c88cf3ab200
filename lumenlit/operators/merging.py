"""Merging pools of candidates and filling blanks from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.text import distinct_ignoring_case

# Sources that are preprint servers.
PREPRINTS = ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "ssrn", "research square", "preprints.org", "hal ", "osf preprint", "techrxiv", "eartharxiv")


def merge_candidates(df: DataFrame) -> DataFrame:
    """One row for each lower-cased ``arxiv_id`` that isn't blank.

    Input has ``pool``, ``row`` (arrival order), ``arxiv_id``, ``title``, ``abstract``,
    ``comments``, ``journal_ref``, ``doi``, ``category``, ``query``. The longest abstract,
    the first values that aren't blank, the first title, all queries in order. A key's
    queries are distinct before they are gathered, so a hot key gathers only those.
    """
    place = F.struct("pool", "row")
    key = F.lower(F.trim("arxiv_id"))
    named = df.where(F.coalesce(F.trim("arxiv_id"), F.lit("")) != "").withColumn("key", key)
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", place)), F.lit("")).alias(c)
    longest = F.max_by("abstract", F.struct(F.length("abstract"), -F.col("pool"), -F.col("row"))).alias("abstract")
    rows = named.groupBy("key").agg(F.min_by("title", place).alias("title"), longest, *(first(c) for c in ("comments", "journal_ref", "doi", "category")), F.min(place).alias("place"))
    each = named.groupBy("key", "query").agg(F.min(place).alias("at"))
    queries = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "query"))), lambda x: x["query"]).alias("queries"))
    return rows.join(queries, "key").withColumn("queries", distinct_ignoring_case(F.col("queries")))


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The whole first row of each key; a hot key is one row from each task."""
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(first).select(key, *(F.col(f"_row.{c}").alias(c) for c in others))


def fill_blanks(df: DataFrame, other: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Blank fields take the other table's value; of several rows for a key only the first (by ``order``) is asked."""
    one = first_rows(other.select(key, *dict.fromkeys([*fields, *order])), key, order).select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    joined = df.join(one, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in fields}).drop(*(f"_{c}" for c in fields))


def is_preprint_source(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for marker in PREPRINTS:
        out = out | low.contains(marker)
    return out


def enrich(candidates: DataFrame, works: DataFrame, least: float = 0.3, most: int = 6, where: Column | None = None) -> DataFrame:
    """Citations, concepts and journal from ``works`` (``doi``, ``cited_by``, ``source``, ``concepts``) by DOI.

    A candidate's own DOI comes first, else the one its identifier implies. Concepts are
    those of ``least`` score among the first ``most``; a journal is taken only where it is
    blank and the source isn't a preprint server. Of several works with one DOI the most
    cited counts, then the first by source. Rows for which ``where`` doesn't hold aren't looked up.
    """
    wanted = F.lit(True) if where is None else where
    key = F.when(F.col("doi") != "", F.lower("doi")).when(F.col("arxiv_id") != "", F.concat(F.lit("10.48550/arxiv."), F.lower("arxiv_id")))
    found = works.select(F.lower("doi").alias("_doi"), F.col("cited_by").alias("_cited"), F.col("source").alias("_source"), F.col("concepts").alias("_concepts"), (-F.coalesce("cited_by", F.lit(-1))).alias("_less"))
    found = first_rows(found, "_doi", ["_less", "_source"]).drop("_less")
    joined = candidates.join(found, wanted & (key == F.col("_doi")), "left")
    concepts = F.transform(F.filter(F.slice("_concepts", 1, most), lambda c: c["score"] >= least), lambda c: c["display_name"])
    journal = F.when((F.col("journal_ref") == "") & ~is_preprint_source(F.coalesce("_source", F.lit("arxiv"))), F.col("_source")).otherwise(F.col("journal_ref"))
    return joined.withColumns({"citations": F.col("_cited").cast("int"), "concepts": F.coalesce(concepts, F.array().cast("array<string>")), "journal_ref": journal, "enriched": F.col("_doi").isNotNull()}).drop("_doi", "_cited", "_source", "_concepts")


def with_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """``seen_before``, ``seen_times``, ``last_recommended`` from the history by identifier."""
    known = history.select(F.col("arxiv_id").alias("_id"), "times", "last_at")
    joined = candidates.join(known, F.col("arxiv_id") == F.col("_id"), "left")
    return joined.withColumns({"seen_before": F.col("_id").isNotNull(), "seen_times": F.coalesce("times", F.lit(0)), "last_recommended": F.col("last_at")}).drop("_id", "times", "last_at")


def skip_seen_guarded(df: DataFrame, top_n: int, seen: str = "seen_before") -> DataFrame:
    """Drop rows that were seen, but only if at least ``top_n`` others remain."""
    fresh = df.agg(F.count_if(~F.col(seen)).alias("_fresh"))
    return df.crossJoin(F.broadcast(fresh)).where((F.col("_fresh") < top_n) | ~F.col(seen)).drop("_fresh")


#: What a report tells of a paper that a history row may lack.
REPORTED = ("authors", "published", "journal", "categories", "title", "citations")


def history_with_reports(history: DataFrame, items: DataFrame) -> DataFrame:
    """History rows whose blank fields are filled from reports.

    ``items`` has ``arxiv_id``, ``place`` (order: the newest report's items first) and the
    fields of ``REPORTED`` as text; of a paper's items only the first is asked.
    """
    filled = fill_blanks(history.withColumn("citations", F.coalesce(F.col("citations").cast("string"), F.lit(""))), items, "arxiv_id", list(REPORTED), ["place"])
    return filled.withColumn("citations", F.col("citations").try_cast("int"))


def items_with_history(items: DataFrame, history: DataFrame) -> DataFrame:
    """Report items (``arxiv_id`` and what they tell) with the explanation and counts that the history has of the paper."""
    known = history.select(F.col("arxiv_id").alias("_id"), "summary", "ideas", "analyzed", "times", "last_at")
    joined = items.where(F.trim(F.coalesce(F.col("arxiv_id").cast("string"), F.lit(""))) != "").join(known, F.col("arxiv_id") == F.col("_id"), "left")
    return joined.withColumns({
        "summary": F.coalesce("summary", F.lit("")), "ideas": F.coalesce("ideas", F.lit("")), "analyzed": F.coalesce("analyzed", F.lit(False)),
        "seen_before": F.col("_id").isNotNull(), "seen_times": F.coalesce("times", F.lit(0)), "last_recommended": F.col("last_at"),
    }).drop("_id", "times", "last_at")
