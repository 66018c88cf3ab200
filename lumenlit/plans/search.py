"""Search expressions compiled to a Column.

Terms are words or quoted phrases, with an optional field prefix; AND, OR and ANDNOT
stand between terms, neighbours without one are joined by AND, operators at the edges are
dropped. Evaluation goes from left to right; a term matches whole words, case folded.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field prefixes of the expression language, and what they search.
FIELDS = {
    "ti": "title", "title": "title", "abs": "abstract", "abstract": "abstract", "au": "authors", "author": "authors", "cat": "category", "primary_category": "category",
    "co": "comments", "comment": "comments", "jr": "journal_ref", "journal_ref": "journal_ref", "rn": "report_no", "report_no": "report_no", "id": "arxiv_id", "doi": "doi",
    "acm_class": "acm_class", "msc_class": "msc_class", "all": "all",
}
OPERATORS = ("AND", "OR", "ANDNOT")


def parse(query: str) -> list[tuple[str, str, str]]:
    """(operator, field, text) of each term; the first operator is always AND."""
    terms: list[tuple[str, str, str]] = []
    pending = ""
    for prefix, phrase, word in re.findall(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', query or ""):
        if not prefix and word.upper() in OPERATORS:
            pending = pending or (word.upper() if terms else "")
            continue
        if prefix.lower() not in FIELDS:
            prefix, word = "all", word if not prefix else f"{prefix}:{word}" if word else word
        terms.append((pending or "AND", prefix.lower(), phrase or word))
        pending = ""
    return terms


def expression(query: str, categories: Sequence[str] = ()) -> str:
    """The expression in full, as a remote source takes it."""
    out = ""
    for op, field, text in parse(query):
        term = f'{field}:"{text}"' if " " in text else f"{field}:{text}"
        out = f"{out} {op} {term}" if out else term
    limit = " OR ".join(f"cat:{c}" for c in categories)
    return f"({out}) AND ({limit})" if out and limit else out or limit


def predicate(query: str, columns: Mapping[str, Column], categories: Sequence[str] = ()) -> Column:
    """The expression as a condition over the columns of a table; an empty one holds everywhere."""

    def holds(field: str, text: str) -> Column:
        target = FIELDS[field]
        names = list(columns) if target == "all" else [target] if target in columns else []
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_]){re.escape(text)}(?![\p{{L}}\p{{N}}_])"
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(columns[n].rlike(pattern), F.lit(False))
        return hit

    out: Column | None = None
    for op, field, text in parse(query):
        term = holds(field, text)
        out = term if out is None else out | term if op == "OR" else out & ~term if op == "ANDNOT" else out & term
    out = F.lit(True) if out is None else out
    return out & columns["category"].isin(*categories) if categories and "category" in columns else out


def search_table(papers: DataFrame, query: str, categories: Sequence[str] = (), limit: int = 2000) -> DataFrame:
    """The newest papers of a table that the expression finds, with the expression as ``query``."""
    names = [n for n in sorted(set(FIELDS.values())) if n in papers.columns]
    found = papers.where(predicate(query, {n: F.col(n) for n in names}, categories))
    return found.orderBy(F.desc("published"), "arxiv_id").limit(limit).withColumn("query", F.lit(query))


def by_ids(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """The papers with given identifiers (column ``arxiv_id``), each once."""
    return papers.join(ids.select("arxiv_id").distinct(), "arxiv_id", "left_semi")


def library_search(records: DataFrame, query: str) -> DataFrame:
    """Library records that hold the text anywhere: title, file, publication, identifiers, authors, tags of either kind."""
    lists = [F.array_join(c, " ") for c in ("authors", "tags", "auto_tags") if c in records.columns]
    plain = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "file", "publication", "arxiv_id", "doi") if c in records.columns]
    return _holding(records, F.concat_ws(" ", *plain, *lists), query)


def run_search(items: DataFrame, query: str) -> DataFrame:
    """Items of a past run that hold the text in title, authors, journal, flags or rank."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "authors", "journal", "flags", "rank")]
    return _holding(items, F.concat_ws(" ", *plain), query)


def _holding(df: DataFrame, hay: Column, query: str) -> DataFrame:
    wanted = query.strip().lower()
    return df.where(F.contains(F.lower(hay), F.lit(wanted))) if wanted else df
