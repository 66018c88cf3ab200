"""Scores, flags and bands as Column expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default ranking parameters.
WEIGHTS = (0.60, 0.20, 0.20)
FALLBACK_WEIGHTS = (0.6, 0.2, 0.2)
TAU_DAYS, HARD_DAYS, CITATION_SCALE, JOURNAL_BONUS, VENUE_BONUS = 365.0, 1460.0, 200.0, 0.15, 0.10
UNKNOWN_RECENCY, FAMOUS, NEW_DAYS, LISTED_NEW_DAYS = 0.3, 50, 120, 180
# The words of a list's flags.
LIST_FLAGS = {"chosen": "推荐", "times": "推荐 %d 次", "seen": "已推荐过", "published": "已发表", "famous": "经典", "new": "新", "reused": "复用解读", "analyzed": "已解读"}
# The reason given for a score without a judge.
HEURISTIC_REASON = "（启发式 TF-IDF 相似度）"
VENUES = ("phys. rev. lett", "prl", "nature", "science", "phys. rev. x", "prx", "nature physics", "nature materials", "pnas", "npj", "phys. rev. b", "prb", "quantum", "scipost")


def age_days(published: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))
    return F.greatest(seconds / 86400.0, F.lit(0.0))


def recency(published: Column, as_of: Column, tau: float = TAU_DAYS, hard: float = HARD_DAYS, updated: Column | None = None) -> Column:
    """Decay by age; a row without its first date takes the one of its last update, if that is given."""
    dated = published if updated is None else F.coalesce(published, updated)
    age = age_days(dated, as_of)
    decayed = F.exp(-age / F.lit(tau)) if tau > 0 else F.lit(1.0)
    old = (age > hard) if hard > 0 else F.lit(False)
    return F.when(dated.isNull(), UNKNOWN_RECENCY).when(old, 0.0).otherwise(decayed)


def importance(citations: Column, journal: Column, comments: Column, scale: float = CITATION_SCALE, venues: tuple[str, ...] = VENUES) -> Column:
    cited = F.when(citations > 0, F.least(F.lit(1.0), F.log1p(citations.cast("double")) / F.log1p(F.lit(float(scale))))).otherwise(0.0)
    journal = F.coalesce(journal, F.lit(""))
    place = F.lower(F.concat_ws(" ", journal, F.coalesce(comments, F.lit(""))))
    venue = F.lit(False)
    for v in venues:
        venue = venue | place.contains(v)
    return F.least(F.lit(1.0), cited + F.when(journal != "", JOURNAL_BONUS).otherwise(0.0) + F.when(venue, VENUE_BONUS).otherwise(0.0))


def combined(relevance: Column, recent: Column, important: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    a, b, c = weights if sum(weights) > 0 else FALLBACK_WEIGHTS
    return (relevance * a + recent * b + important * c) / (a + b + c)


def is_famous(citations: Column, least: int = FAMOUS) -> Column:
    return F.coalesce(citations >= least, F.lit(False))


def is_new(published: Column, as_of: Column, days: int = NEW_DAYS) -> Column:
    return F.coalesce(age_days(published, as_of) <= days, F.lit(False))


def band(score: Column) -> Column:
    return F.when(score >= 0.65, "good").when(score >= 0.35, "mid").otherwise("low")


def flags(published: Column, citations: Column, journal: Column, as_of: Column) -> Column:
    text = F.concat_ws(" ", F.when(is_new(published, as_of), "🆕新"), F.when(is_famous(citations), "⭐经典"), F.when(F.coalesce(journal, F.lit("")) != "", "📖已发表"))
    return F.when(text == "", "—").otherwise(text)


def bar(value: Column, width: int = 10) -> Column:
    filled = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def judged(score: Column) -> Column:
    """A judge's 0..100 as 0..1; null if it is no number."""
    number = score.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number / 100)))


def list_flags(chosen: Column, from_history: Column, seen_before: Column, seen_times: Column, journal: Column, citations: Column, published: Column, analyzed: Column, reused: Column, as_of: Column) -> Column:
    """What a list says of a row: chosen, how often or that it was seen, published, famous, new, explained anew or reused."""
    word = {k: F.lit(v) for k, v in LIST_FLAGS.items()}
    times = F.when(seen_times > 0, F.format_string(LIST_FLAGS["times"], seen_times.cast("int"))).otherwise(word["seen"])
    return F.concat_ws(
        " ",
        F.when(chosen, word["chosen"]),
        F.when(from_history, times).when(seen_before, word["seen"]),
        F.when(F.coalesce(journal, F.lit("")) != "", word["published"]),
        F.when(is_famous(citations), word["famous"]),
        F.when(is_new(published, as_of, LISTED_NEW_DAYS), word["new"]),
        F.when(analyzed, F.when(reused, word["reused"]).otherwise(word["analyzed"])),
    )


def chosen_relevance(judge: Column, judge_reason: Column, heuristic: Column) -> tuple[Column, Column]:
    """Relevance and its reason: the judge's where there is one, else the heuristic's."""
    return F.coalesce(judge, heuristic, F.lit(0.0)), F.when(judge.isNotNull(), F.coalesce(judge_reason, F.lit(""))).otherwise(HEURISTIC_REASON)
