"""Text, identifier and date functions as Column expressions.

All stay in whole-stage code except ``fold_accents``, for which Spark has no expression
(compatibility decomposition), and which runs as an Arrow UDF only on rows that are not
plain ASCII.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# DOI prefixes, in the order in which they are stripped.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:", "doi ")
# Identifier shapes.
NEW_ID = r"\b(\d{4}\.\d{4,5})(v\d+)?\b"
OLD_ID = r"(?i)\b([a-z][a-z\-]+(?:\.[a-z]{2})?/\d{7})(v\d+)?\b"
# Separators at which a long text is cut, in order.
CUTS = (". ", "。", "; ", ", ")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_latex(c: Column) -> Column:
    """Maths and commands become spaces, braces and backslashes too (the pattern is a fixed value)."""
    commands = F.regexp_replace(text_or_empty(c), r"\$[^$]*\$|\\(?:[a-zA-Z]+|.)", " ")
    return F.translate(commands, "{}\\", "   ")


def clean_text(c: Column) -> Column:
    """No-break spaces become spaces, zero-width spaces go, white space collapses."""
    return F.trim(F.regexp_replace(F.translate(text_or_empty(c), " ​", " "), r"\s+", " "))


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks."""

    # Defined here so that it travels to the workers by value.
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)), na_action="ignore")

    return F.pandas_udf(fold, "string")(c)


def normalize_title(c: Column, ascii_only: bool = False) -> Column:
    """The key under which two spellings of a title are equal; ``ascii_only`` skips the accents' UDF."""
    plain = strip_latex(c)
    folded = plain if ascii_only else F.when(plain.rlike(r"[^\x00-\x7F]"), fold_accents(plain)).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def truncate(c: Column, limit: int, ellipsis: str = "…") -> Column:
    """At most ``limit`` characters, cut after a separator if one lies beyond 60 % of them."""

    def cut(head: Column) -> Column:
        out = F.rtrim(head)
        for sep in reversed(CUTS):
            last = F.length(head) - F.instr(F.reverse(head), sep[::-1]) - len(sep) + 1
            found = (F.instr(head, sep) > 0) & (last > 0.6 * limit)
            out = F.when(found, F.rtrim(F.substring(head, F.lit(1), last + 1))).otherwise(out)
        return F.concat(out, F.lit(ellipsis))

    return let(text_or_empty(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(let(F.substring(t, 1, limit), cut)))


def norm_doi(c: Column) -> Column:
    out = F.lower(F.trim(text_or_empty(c)))
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, "^" + re.escape(prefix), "")
    return F.regexp_replace(F.trim(out), r"^\.+|\.+$", "")


def arxiv_id(c: Column) -> Column:
    """The identifier in a text without its version, or the empty string.

    A link to the site wins; another site's URL counts only if the text names the site.
    """
    c = text_or_empty(c)
    tail = F.regexp_replace(F.regexp_extract(c, r"(?i)arxiv\.org/(?:abs|pdf)/([^\s?#]+)", 1), r"(?i)\.pdf$", "")
    new, old = (lambda x: F.regexp_extract(x, NEW_ID, 1)), (lambda x: F.regexp_extract(x, OLD_ID, 1))
    linked = F.lower(F.coalesce(F.nullif(new(tail), F.lit("")), old(tail)))
    foreign = c.rlike(r"[a-zA-Z][a-zA-Z0-9+.\-]*://") & ~c.rlike("(?i)arxiv")
    bare = F.coalesce(F.nullif(F.lower(old(c)), F.lit("")), new(c))
    return F.when(linked != "", linked).when(foreign, "").otherwise(bare)


def arxiv_version(c: Column) -> Column:
    c = text_or_empty(c)
    return F.when(c.rlike(NEW_ID), F.regexp_extract(c, NEW_ID, 2)).otherwise(F.regexp_extract(c, OLD_ID, 2))


def parse_year(c: Column, as_of_year: int) -> Column:
    year = F.regexp_extract(text_or_empty(c), r"(1[89]\d{2}|20\d{2})", 1).try_cast("int")
    return F.when(year.between(1800, as_of_year + 2), year)


def parse_month_date(c: Column) -> Column:
    """A date such as "25 September, 2026": missing parts are 1, days are held to 1..28."""
    low = F.lower(text_or_empty(c))
    months = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    name = F.regexp_extract(low, rf"\b({'|'.join(months)})[a-z]*\b", 1)
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, months)), name), F.lit(0)), F.lit(1))
    day = F.coalesce(F.regexp_extract(low, rf"\b(\d{{1,2}})\s+(?:{'|'.join(months)})", 1).try_cast("int"), F.lit(1))
    year = F.regexp_extract(low, r"(1[89]\d{2}|20\d{2})", 1).try_cast("int")
    return F.when(year.isNotNull(), F.make_date(year, month.cast("int"), F.greatest(F.lit(1), F.least(day, F.lit(28)))))


def parse_dt(c: Column) -> Column:
    """ISO first, then common layouts, else null."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(F.try_to_timestamp(c), *(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def rfc822(c: Column) -> Column:
    """A feed's date; the offset is dropped without converting; null if it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"^\s*\w+,\s*", ""), r"\s*(?:[+-]\d{4}|[A-Z]{1,4})\s*$", "")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")


def split_tags(c: Column) -> Column:
    """Up to 20 distinct tags of up to 40 characters, parted by either comma or either semicolon."""
    parts = F.filter(F.transform(F.split(text_or_empty(c), "[,，;；]"), lambda t: F.trim(t)), lambda t: t != "")
    return F.slice(F.array_distinct(F.transform(parts, lambda t: F.substring(t, 1, 40))), 1, 20)


def distinct_ignoring_case(c: Column) -> Column:
    """Trimmed values, the first spelling of each, in order; blanks and nulls go. Sorted twice, so long lists cost little more."""
    values = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    keyed = F.array_sort(F.transform(values, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(keyed, lambda rows: F.filter(rows, lambda e, i: (i == 0) | (F.get(rows, i - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def _character(code: Column) -> Column:
    """The character of a number as a web page means it: Windows's where a control code is meant, nothing for no character."""
    windows = {i: bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0)}
    meant = F.from_json(F.lit(json.dumps({str(i): c if c != "\ufffd" else chr(i) for i, c in windows.items()} | {"0": "\ufffd", "13": "\r"})), "map<string,string>")
    low, plane = code % 0x10000, F.hex(code)
    none = ((code < 0x20) & ~code.isin(9, 10, 12)) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | low.isin(0xFFFE, 0xFFFF)
    short, long = F.decode(F.unhex(F.lpad(plane, 4, "0")), "UTF-16BE"), F.decode(F.unhex(F.lpad(plane, 8, "0")), "UTF-32")
    bad = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, "\ufffd").when((code < 0xA0) & F.try_element_at(meant, code.cast("string")).isNotNull(), F.try_element_at(meant, code.cast("string"))).when(none, "").when(code < 0x10000, short).otherwise(long)


def unescape(c: Column, unfinished: bool = True) -> Column:
    """A text with its HTML entities resolved once: by name, with or without semicolon, and by number.

    The text is cut at ``&`` and each part's beginning looked up; the names are those of
    the standard library's table, which is one constant of the plan. Without ``unfinished``
    an entity needs its semicolon, so one that was cut off stays as it is.
    """
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    # Names that need no semicolon may be the beginning of a longer word; the longest one counts.
    open_names = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    end = "?" if unfinished else ""

    def resolved(part: Column) -> Column:
        number = F.regexp_extract(part, r"^#([0-9]+|[xX][0-9a-fA-F]+);" + end, 0)
        digits = F.regexp_replace(number, "[#;]", "")
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 1 << 20), 16, 10)).otherwise(digits).try_cast("long")
        name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};" + end, 0)
        begin = F.regexp_extract(part, f"^(?:{open_names})", 0) if unfinished else F.lit("")
        after = lambda x: F.substring(part, F.length(x) + 1, F.length(part))
        whole = F.try_element_at(names, name)
        return (
            F.when(number != "", F.concat(_character(code), after(number)))
            .when((name != "") & whole.isNotNull(), F.concat(whole, after(name)))
            .when(begin != "", F.concat(F.try_element_at(names, begin), after(begin)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(c, "&")
    rest = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), resolved), "")
    return F.when(c.contains("&"), F.concat(F.get(parts, 0), rest)).otherwise(c)


def int_or_null(c: Column) -> Column:
    """A whole number in a text, else null ("3.0" counts, "3.5" and "true" don't)."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def markdown_cell(c: Column) -> Column:
    return F.trim(F.replace(F.replace(text_or_empty(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def plain_title(c: Column) -> Column:
    return F.trim(F.replace(text_or_empty(c), F.lit("$"), F.lit("")))


def short_label(title: Column, authors: Column, year: Column) -> Column:
    """Last word of the first author and the year, else the author, else the title's start."""
    first = F.trim(text_or_empty(F.get(authors, 0)))
    last = F.element_at(F.split(first, r"\s+"), -1)
    return F.when((first != "") & year.isNotNull(), F.concat_ws(" ", last, year.cast("string"))).when(first != "", first).otherwise(F.substring(title, 1, 40))


def shown_date(published: Column, updated: Column) -> Column:
    """The first date, else that of the last update, else a dash."""
    return F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.date_format(updated, "yyyy-MM-dd"), F.lit("—"))


def author_line(c: Column, limit: int = 1) -> Column:
    """Up to ``limit`` authors, and a mark if there are more; a dash for none."""
    named = F.filter(F.transform(c, lambda a: F.trim(a)), lambda a: a != "")
    shown = F.array_join(F.slice(named, 1, limit), ", ")
    return F.when(F.size(named) > limit, F.concat(shown, F.lit(" 等"))).when(F.size(named) > 0, shown).otherwise("—")


def shown_journal(c: Column, limit: int = 24) -> Column:
    """A journal reference, cut to ``limit``; a dash for none."""
    text = F.trim(text_or_empty(c))
    return F.when(text == "", "—").otherwise(truncate(text, limit))


def elapsed(seconds: Column) -> Column:
    """Seconds, or minutes and seconds from a minute on."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm%02ds", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int")))


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}_]{2,}+"), F.lit(0))


def grams(words: Column, stop: list[str], pairs: bool = True) -> Column:
    """Words without stop words, then the pairs of neighbours that are left."""
    kept = F.filter(words, lambda t: ~t.isin(*stop)) if stop else words
    if not pairs:
        return kept
    return let(kept, lambda k: F.concat(k, F.transform(F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", F.get(k, i), t))))


def significant_tokens(title: Column, least: int = 5) -> Column:
    return F.array_distinct(F.filter(F.split(title, " "), lambda t: F.length(t) >= least))
