"""The recommendation pipeline as one lazy DataFrame for each stage.

Stages: library, merged candidates, anti-join with the library, history, enrichment,
relevance by a judge where one has scored, ranking with a relevance floor, top-N.
``Recommendation.plan`` returns the DataFrame of a
stage; all of it is lazy, but for the ids that linkage leaves and the cosines,
which are checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.functions import scoring
from lumenlit.functions.text import normalize_title, strip_latex
from lumenlit.operators import linkage, merging, ranking, tfidf
from lumenlit.operators.graph import shared_folder
from lumenlit.plans import search

STAGES = ("candidates", "new", "history", "enriched", "scored", "ranked", "top")


@dataclass(frozen=True)
class Options:
    """What a run can be told; ``as_of`` is the run's present."""

    as_of: str
    top_n: int = 20
    #: How many arrive, and how many of the most similar are looked up; 0 is all.
    candidate_cap: int = 800
    judged_cap: int = 300
    enriched_cap: int = 400
    min_relevance: float = 0.30
    weights: tuple[float, float, float] = scoring.WEIGHTS
    tau_days: float = scoring.TAU_DAYS
    hard_days: float = scoring.HARD_DAYS
    citation_scale: float = scoring.CITATION_SCALE
    venues: tuple[str, ...] = scoring.VENUES
    stop_words: tuple[str, ...] = field(default_factory=lambda: tuple(tfidf.english_stop_words()))
    skip_seen: bool = True
    fuzzy: bool = True
    bigrams: bool = True
    #: Search expressions, any of which a candidate must meet (none: all), and categories that it must have one of.
    queries: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    #: Candidates are the announcements of the categories on the day of ``as_of`` or after; expressions don't count.
    subscribe: bool = False
    use_history: bool = True
    use_works: bool = True
    use_judged: bool = True

    def override(self, **given: Any) -> Options:
        """Options with what was given; None leaves a value as it is."""
        known = {f.name for f in fields(self)}
        if bad := set(given) - known:
            raise ValueError(f"unknown options: {sorted(bad)}")
        return replace(self, **{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class Recommendation:
    """Tables: ``pools`` (arriving candidates), ``library``, and optionally ``history``, ``works`` and ``judged``.

    ``judged`` has ``id``, ``score`` (0..1) and ``reason``; see ``for_judge`` for whom to ask about.
    """

    pools: DataFrame
    library: DataFrame
    profile: str
    options: Options
    history: DataFrame | None = None
    works: DataFrame | None = None
    judged: DataFrame | None = None

    def heuristic(self, df: DataFrame) -> DataFrame:
        """The candidates with ``heuristic``, their similarity to the profile."""
        o = self.options
        text = F.concat_ws(" ", strip_latex(F.col("title")), strip_latex(F.col("abstract")))
        fit = tfidf.relevance(self.profile, df, "id", text, list(o.stop_words), o.bigrams)
        return df.join(fit.select(F.col("doc").alias("id"), F.col("relevance").alias("heuristic")), "id")

    def for_judge(self) -> DataFrame:
        """The candidates that a judge is to score: the most similar ``judged_cap``."""
        return ranking.most_relevant(self.heuristic(self.plan("history")), self.options.judged_cap, "heuristic")

    def searched(self) -> DataFrame:
        """The arriving candidates that the run asks for: by expressions and categories, or by subscription."""
        o, df = self.options, self.pools
        names = [n for n in sorted(set(search.FIELDS.values())) if n in df.columns]
        if o.subscribe:
            if not o.categories:
                raise ValueError("a subscription needs a category")
            day = F.to_date(F.lit(o.as_of).cast("timestamp_ntz"))
            arrived = F.coalesce(*(F.col(c) for c in ("announced", "published") if c in df.columns))
            return df.where(F.col("category").isin(*o.categories) & (F.to_date(arrived) >= day))
        if o.categories:
            df = df.where(F.col("category").isin(*o.categories))
        if o.queries:
            found = F.lit(False)
            for q in o.queries:
                found = found | search.predicate(q, {n: F.col(n) for n in names})
            df = df.where(found)
        return df

    def plan(self, stop_at: str = "top") -> DataFrame:
        if stop_at not in STAGES:
            raise ValueError(f"no stage {stop_at}")
        o = self.options
        # The cap is by arrival and comes before anything that scores.
        df = self.searched()
        df = df.orderBy("pool", "row").limit(o.candidate_cap) if o.candidate_cap else df
        if stop_at == "candidates":
            return df
        # What linkage leaves is kept as ids, since every later stage reads it more than once.
        shared_folder(df)
        new = linkage.not_in_library(df, self.library, similar=o.fuzzy).select("id").checkpoint()
        df = df.join(new, "id", "left_semi")
        if stop_at == "new":
            return df
        if self.history is not None and o.use_history:
            df = merging.with_history(df, self.history)
            if o.skip_seen:
                df = merging.skip_seen_guarded(df, o.top_n)
        if stop_at == "history":
            return df
        df = self.heuristic(df)
        if self.works is not None and o.use_works:
            if o.enriched_cap:
                # Only the most similar are looked up; the others stay as they are.
                asked = ranking.most_relevant(df, o.enriched_cap, "heuristic").select("id", F.lit(True).alias("_asked"))
                df = merging.enrich(df.join(asked, "id", "left"), self.works, where=F.coalesce("_asked", F.lit(False))).drop("_asked")
            else:
                df = merging.enrich(df, self.works)
        if stop_at == "enriched":
            return df
        judged = self.judged if self.judged is not None and o.use_judged else df.select("id", F.lit(None).cast("double").alias("score"), F.lit("").alias("reason")).limit(0)
        df = df.join(judged.select("id", F.col("score").alias("_judge"), F.col("reason").alias("_why")), "id", "left")
        relevance, reason = scoring.chosen_relevance(F.col("_judge"), F.col("_why"), F.col("heuristic"))
        df = df.withColumns({"relevance": relevance, "relevance_reason": reason}).drop("_judge", "_why", "heuristic")
        now = F.lit(o.as_of).cast("timestamp_ntz")
        df = df.withColumn("recency", F.round(scoring.recency(F.col("published"), now, o.tau_days, o.hard_days, F.col("updated") if "updated" in df.columns else None), 6))
        df = df.withColumn("importance", F.round(scoring.importance(F.col("citations"), F.col("journal_ref"), F.col("comments"), o.citation_scale, o.venues), 6))
        df = df.withColumn("score", F.round(scoring.combined(F.col("relevance"), F.col("recency"), F.col("importance"), o.weights), 6))
        if stop_at == "scored":
            return df
        df = ranking.relevance_floor(df, o.min_relevance)
        return df if stop_at == "ranked" else ranking.top_n(df, o.top_n)


def with_keys(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A table of papers with the normalised title that linkage needs."""
    return df.withColumn("norm_title", normalize_title(F.col("title"), ascii_only))
