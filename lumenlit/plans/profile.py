"""Research profiles: keywords from a library, and queries from a profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.text import distinct_ignoring_case, truncate
from lumenlit.operators import ranking, tfidf


def paper_line(title: Column, year: Column, publication: Column, body: Column) -> Column:
    """A paper in one line: title (year) [publication] — up to 300 characters of its text."""
    head = F.concat(title, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")), F.when(F.coalesce(publication, F.lit("")) != "", F.concat(F.lit(" ["), publication, F.lit("]"))).otherwise(""))
    return F.concat_ws(" — ", head, F.nullif(truncate(body, 300), F.lit("")))


def digest(library: DataFrame, line: Column, order: list, limit: int = 40_000) -> DataFrame:
    """Lines of the library, in order, within a budget of characters."""
    return ranking.prefix_within(library.withColumn("line", line), None, order, F.length("line"), limit)


def keywords(library: DataFrame, doc_id: str, text: Column, stop: list[str] | None = None, n: int = 30, config: tfidf.Config = tfidf.KEYWORDS) -> DataFrame:
    """The library's heaviest pairs of words, then half as many single words; none where the fit leaves nothing."""
    counts = tfidf.term_counts(library, doc_id, text, tfidf.PROFILE_STOPS if stop is None else stop)
    try:
        fit = tfidf.fitted(counts, library.count(), config)
    except tfidf.NothingLeft:
        counts, fit = counts.limit(0), tfidf.fit(counts.limit(0), 0)
    return tfidf.top_terms(fit.transform(counts), n, n // 2)


# The lists that give queries, in order, and how many words a query has at most.
TERM_LISTS, QUERY_WORDS = ("queries", "keywords", "methods", "topics"), 6


def queries_from_terms(groups: list[list[str]], limit: int) -> list[str]:
    """Distinct terms with ASCII letters, cut to six words, group after group; one at least where there is any."""
    seen: dict[str, str] = {}
    for term in (str(t).strip() for g in groups for t in g):
        if any(c.isascii() and c.isalpha() for c in term):
            words = term.split()
            cut = " ".join(words[:QUERY_WORDS]) if len(words) > QUERY_WORDS else term
            seen.setdefault(cut.lower(), cut)
    return list(seen.values())[: max(1, limit)]


def term_queries(profiles: DataFrame, limit: int) -> Column:
    """The same of profiles as rows, whose columns are ``TERM_LISTS`` (arrays of texts, nulls allowed)."""
    every = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in TERM_LISTS))
    english = F.filter(F.transform(every, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t.rlike("[A-Za-z]"))
    words = lambda t: F.split(t, r"\s+")
    cut = F.transform(english, lambda t: F.when(F.size(words(t)) > QUERY_WORDS, F.array_join(F.slice(words(t), 1, QUERY_WORDS), " ")).otherwise(t))
    return F.slice(distinct_ignoring_case(cut), 1, max(1, limit))


def chosen_queries(manual: list[str], from_model: list[str], from_terms: list[str], limit: int) -> tuple[list[str], str]:
    """Queries and where they come from: given by hand, else by a model, else from terms."""
    for source, found in (("manual", manual), ("model", from_model), ("terms", from_terms)):
        if found:
            return found[: max(limit, len(manual))], source
    return [], "none"


#: What a profile is made of, list by list.
PARTS = ("topics", "methods", "keywords", "subfields")
# Heads of the digest and how many of each list it shows.
DIGEST = (("topics", "主要主题: ", "、", 15), ("methods", "常用方法: ", "、", 12), ("keywords", "关键词: ", ", ", 40))
SUMMARY_HEAD = "研究方向概述: "


def merged_groups(results: DataFrame, order: str = "n") -> DataFrame:
    """Answers about groups of papers as one row: each list of ``PARTS`` in the groups' order, each value once.

    Values are told apart group by group before they are gathered, so a value that many
    groups name is gathered once.
    """
    out = None
    for part in PARTS:
        each = results.select(F.col(order).alias("_n"), F.posexplode(part).alias("_i", "_v")).where(F.trim(F.coalesce("_v", F.lit(""))) != "")
        first = each.groupBy(F.lower(F.trim("_v")).alias("_k")).agg(F.min(F.struct("_n", "_i", F.trim("_v").alias("v"))).alias("_at"))
        row = first.agg(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x["v"]).alias(part))
        out = row if out is None else out.crossJoin(row)
    return out.select(*(distinct_ignoring_case(F.col(p)).alias(p) for p in PARTS))


def scoring_digest(profile: DataFrame) -> DataFrame:
    """``digest`` of each profile (``summary`` and lists) as lines of text; blank parts are left out."""
    lines = [F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(SUMMARY_HEAD), "summary"))]
    lines += [F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.slice(c, 1, n), mark))) for c, head, mark, n in DIGEST]
    return profile.withColumn("digest", F.concat_ws("\n", *lines))


def decided(model: Mapping[str, Any] | None, heuristic: Mapping[str, Any], manual: Sequence[str], limit: int) -> dict[str, Any]:
    """A profile from a model's answer, its terms or the heuristic, with the queries to use and where they come from."""
    data, source = dict(model or {}), "ai"
    if not data.get("queries") and not data.get("keywords"):
        data, source = dict(heuristic), "heuristic"
    elif not data.get("queries"):
        data["queries"] = queries_from_terms([list(data.get(k) or []) for k in TERM_LISTS], limit)
        source = "ai+terms"
        if not data["queries"]:
            data, source = dict(heuristic), "heuristic"
    given = [q for q in manual if q and q.strip()]
    queries = given or [str(q) for q in data.get("queries") or [] if q]
    once: dict[str, str] = {}
    for q in queries:
        if q.strip():
            once.setdefault(q.strip().lower(), q.strip())
    return data | {"queries": list(once.values())[: max(limit, len(given))], "generated_by": source + ("+manual" if given else "")}
