"""State that outlives a run: history, conversations, tags and the file index.

Each operator takes the old table and a batch and returns the new table, to be written
to a new version of the path; nothing is changed in place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.extract import auto_tags, depth_covers
from lumenlit.functions.scoring import judged
from lumenlit.functions.text import split_tags

#: Fields that a new explanation replaces in a run and on its own, and those that each run refreshes.
EXPLANATION = ("title", "summary", "ideas")
EXPLAINED = ("summary", "ideas", "profile_fp")
REFRESHED = ("authors", "published", "journal", "categories", "citations")


def fingerprint(profile: Mapping[str, Sequence[str] | str] | None) -> str:
    """Sixteen hex digits of a profile's queries, topics, methods, keywords and summary."""
    if not profile:
        return ""
    canonical = json.dumps({k[0]: profile.get(k) for k in ("queries", "topics", "methods", "keywords", "summary")}, ensure_ascii=False, sort_keys=True)
    return hashlib.sha1(canonical.encode()).hexdigest()[:16]


def fingerprint_of(queries: Column, topics: Column, methods: Column, keywords: Column, summary: Column) -> Column:
    """The same of profiles as rows (lists of texts and a text); a null part is written as null."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    parts = lambda c: F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]")), F.lit("null"))
    text = F.coalesce(quoted(summary), F.lit("null"))
    told = [F.lit('{"k": '), parts(keywords), F.lit(', "m": '), parts(methods), F.lit(', "q": '), parts(queries), F.lit(', "s": '), F.when(summary.isNull(), "null").otherwise(text), F.lit(', "t": '), parts(topics), F.lit("}")]
    return F.substring(F.sha1(F.concat(*told)), 1, 16)


def replay(events: DataFrame) -> DataFrame:
    """A history from all its events: ``arxiv_id``, ``at``, ``score``, ``report``, ``analyzed``, ``summary``.

    Times counted, first and last seen, best score, last report, last explanation. The
    report breaks ties of time.
    """
    last = F.struct("at", "report")
    return (
        events.where(F.coalesce(F.trim(F.col("arxiv_id").cast("string")), F.lit("")) != "")
        .groupBy("arxiv_id")
        .agg(
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.count(F.lit(1)).alias("times"),
            F.max("score").alias("best_score"),
            F.max_by("report", last).alias("report"),
            F.max_by("summary", F.when(F.col("analyzed"), last)).alias("summary"),
            F.bool_or("analyzed").alias("analyzed"),
        )
    )


def upsert_history(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A batch (one row for each identifier) merged into the history.

    New rows start at one time; known ones count up and keep their first date, best score
    and, unless the batch explains them anew, their explanation and title.
    """
    new = batch.where(F.coalesce(F.trim("arxiv_id"), F.lit("")) != "")
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, "arxiv_id", "full_outer")
    is_old, is_new = F.col("o.times").isNotNull(), F.col("n.at").isNotNull()
    explained = F.coalesce(F.col("n.analyzed"), F.lit(False))
    take = lambda c: F.when(explained | ~is_old, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    fresh = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(
        "arxiv_id",
        F.coalesce("o.first_at", "n.at").alias("first_at"),
        F.coalesce("n.at", "o.last_at").alias("last_at"),
        (F.coalesce("o.times", F.lit(0)) + is_new.cast("int")).alias("times"),
        F.greatest("o.best_score", "n.score").alias("best_score"),
        fresh("report"),
        F.when(explained, F.col("n.profile_fp")).otherwise(F.coalesce("o.profile_fp", F.lit(""))).alias("profile_fp"),
        (F.coalesce("o.analyzed", F.lit(False)) | explained).alias("analyzed"),
        *(take(c) for c in EXPLANATION),
        *(fresh(c) for c in REFRESHED),
    )


def save_explanations(old: DataFrame, explained: DataFrame, as_of: Column) -> DataFrame:
    """Only the explanation columns of known rows change; unknown rows come in as seen once, now, with score 0.

    ``explained`` has ``arxiv_id``, ``title``, ``report`` and the columns of ``EXPLAINED``, one row for each identifier.
    """
    e = explained.where(F.coalesce(F.trim("arxiv_id"), F.lit("")) != "")
    e = e.select("arxiv_id", *(F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("title", "report", *EXPLAINED)), F.lit(True).alias("_new"))
    joined = old.withColumn("_known", F.lit(True)).join(e, "arxiv_id", "full_outer")
    values = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in EXPLAINED}
    fresh = {"title": F.col("_title"), "report": F.col("_report"), "first_at": as_of, "last_at": as_of, "times": F.lit(1), "best_score": F.lit(0.0)}
    types = {f.name: f.dataType for f in old.schema}
    values |= {c: F.when(F.col("_known"), F.col(c)).otherwise(v.cast(types[c])) for c, v in fresh.items()}
    return joined.withColumns(values | {"analyzed": F.coalesce("analyzed", F.lit(False)) | F.coalesce("_new", F.lit(False))}).select(*old.columns)


def reusable(history: DataFrame, wanted: DataFrame, profile_fp: str) -> DataFrame:
    """Explanations that may be reused: analysed, not blank, made for the same profile."""
    ok = history.where(F.col("analyzed") & (F.trim("summary") != "") & (F.col("profile_fp") == profile_fp))
    return ok.join(wanted.select("arxiv_id"), "arxiv_id", "left_semi")


def migrate(old: DataFrame, current: DataFrame) -> DataFrame:
    """An older table with the columns it lacks; none is dropped."""
    return current.limit(0).unionByName(old, allowMissingColumns=True)


def forget(table: DataFrame, ids: DataFrame, key: str = "arxiv_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def ordered(history: DataFrame, limit: int | None = None) -> DataFrame:
    out = history.orderBy(F.desc("last_at"), F.desc("best_score"), "arxiv_id")
    return out.limit(limit) if limit else out


def missing_metadata(history: DataFrame) -> DataFrame:
    """Rows with blank authors or date; an empty list written as text counts as there."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return history.where(blank("authors") | blank("published"))


def history_totals(history: DataFrame) -> DataFrame:
    """One row: how many papers there are, how many are explained, and the last run."""
    return history.agg(F.count(F.lit(1)).alias("total"), F.count_if("analyzed").alias("analyzed"), F.max("last_at").alias("last_run"))


def repaired(history: DataFrame, source: DataFrame) -> DataFrame:
    """Rows with blank authors or date take the five refreshed columns of ``source``, where it has the paper; nothing else changes."""
    wanted = missing_metadata(history).select("arxiv_id")
    found = source.join(wanted, "arxiv_id", "left_semi").select("arxiv_id", *(F.col(c).alias(f"_{c}") for c in REFRESHED), F.lit(True).alias("_found")).dropDuplicates(["arxiv_id"])
    joined = history.join(found, "arxiv_id", "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in REFRESHED}).drop("_found", *(f"_{c}" for c in REFRESHED))


def append_turns(chat: DataFrame, turns: DataFrame, conversation: str = "arxiv_id", order: str = "id", text: str = "content") -> DataFrame:
    """The conversations with new turns behind; blank turns and those of no conversation go.

    ``order`` counts on from the largest number there is, in the order of the new turns' own.
    """
    last = chat.agg(F.coalesce(F.max(order), F.lit(0)).alias("_last"))
    said = turns.where((F.coalesce(F.trim(F.col(conversation).cast("string")), F.lit("")) != "") & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return chat.unionByName(said.crossJoin(F.broadcast(last)).withColumn(order, F.col(order) + F.col("_last")).drop("_last").select(*chat.columns))


def clear_conversations(chat: DataFrame, ids: DataFrame, conversation: str = "arxiv_id") -> DataFrame:
    """The conversations without those of the given papers; the history isn't touched."""
    return chat.join(ids.select(conversation).distinct(), conversation, "left_anti")


def indexed_at(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Index rows of the given paths."""
    return index.join(paths.select("path").distinct(), "path", "left_semi")


def newest_readable(index: DataFrame, contents: DataFrame) -> DataFrame:
    """For each content hash (``sha1``) the readable row that was seen last."""
    some = index.where(F.col("status").isin("ok", "notext") & (F.coalesce("sha1", F.lit("")) != "")).join(contents.select("sha1").distinct(), "sha1", "left_semi")
    rest = [c for c in index.columns if c != "sha1"]
    last = some.groupBy("sha1").agg(F.max_by(F.struct(*rest), F.struct("seen_at", "path")).alias("_row"))
    return last.select("sha1", *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*index.columns)


def current_index(index: DataFrame, version: int, column: str = "version") -> DataFrame:
    """The index if it was made by this version, else an empty one: it is derived from the files and made anew."""
    other = index.where(~F.col(column).eqNullSafe(F.lit(version))).select(F.lit(1).alias("_other")).limit(1)
    return index.join(F.broadcast(other), F.lit(True), "left_anti")


def set_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """``path``, ``tags``: changed rows replace old ones, and blank tags delete."""
    kept = tags.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.where(F.coalesce(F.trim("tags"), F.lit("")) != "").select(*tags.columns))


def settle_early(listing: DataFrame, index: DataFrame, wanted_depth: str) -> DataFrame:
    """``path``, ``action`` and ``undecided``, from sizes and times alone.

    A file whose size and time are as stored is reused (``reuse``) if it was read deeply
    enough and is to be read again (``deepen``) if it wasn't; rows without a file are
    ``missing``; all others are to be read (``parse``). What is to be read is undecided
    until its content is known. ``listing`` has path, size, mtime; ``index`` the same with status and depth.
    """
    joined = listing.select("path", "size", "mtime").alias("l").join(index.alias("i"), "path", "full_outer")
    here = F.col("l.size").isNotNull()
    same = (F.col("l.size") == F.col("i.size")) & (F.col("l.mtime") == F.col("i.mtime")) & F.col("i.status").isin("ok", "notext", "skipped")
    covers = depth_covers(F.col("i.depth"), F.lit(wanted_depth))
    action = F.when(~here, "missing").when(same & covers, "reuse").when(same, "deepen").otherwise("parse")
    return joined.select("path", action.alias("action")).withColumn("undecided", F.col("action").isin("deepen", "parse"))


def settle_late(early: DataFrame, hashes: DataFrame, index: DataFrame, wanted_depth: str) -> DataFrame:
    """``path``, ``action``, ``from_path`` and ``sha1``, with the contents of the undecided files.

    ``hashes`` has ``path`` and ``sha1`` of those, null where a file can't be read
    (``failed``). Of a content's readable rows the one seen last counts: if it was read
    deeply enough, it is moved (``move``) to the file.
    """
    readable = index.where(F.col("status").isin("ok", "notext") & (F.coalesce("sha1", F.lit("")) != ""))
    newest = readable.groupBy("sha1").agg(F.max_by(F.struct("path", "depth"), F.struct("seen_at", "path")).alias("_row"))
    known = newest.where(depth_covers(F.col("_row.depth"), F.lit(wanted_depth))).select("sha1", F.col("_row.path").alias("from_path"))
    told = hashes.select("path", "sha1", F.lit(True).alias("_told")).join(known, "sha1", "left")
    joined = early.join(told, "path", "left")
    action = F.when(~F.col("undecided"), F.col("action")).when(F.col("_told") & F.col("sha1").isNull(), "failed").when(F.col("from_path").isNotNull(), "move").otherwise(F.col("action"))
    return joined.select("path", action.alias("action"), "from_path", "sha1")


def plan_scan(listing: DataFrame, index: DataFrame, wanted_depth: str, hashed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What to do with each file, in two phases: ``reuse``, ``move``, ``deepen``, ``parse``, ``failed`` or ``missing``.

    ``hashed`` gets a table of the ``path`` of the files that sizes and times leave
    undecided, and returns their ``path`` and ``sha1``; no other file is opened
    (``files.hash_files`` reads them in the tasks).
    """
    early = settle_early(listing, index, wanted_depth)
    return settle_late(early, hashed(early.where("undecided").select("path")), index, wanted_depth)


def mark_missing(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is gone get the status ``missing``; none is deleted."""
    there = listing.select("path", F.lit(True).alias("_there")).distinct()
    return index.join(there, "path", "left").withColumn("status", F.when(F.col("_there"), F.col("status")).otherwise("missing")).drop("_there")


def scan_stats(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("action") == a).alias(a) for a in ("reuse", "move", "deepen", "parse", "failed", "missing")))


def newest_by(df: DataFrame, key: str, order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def index_stats(listing: DataFrame, index: DataFrame, wanted_depth: str) -> DataFrame:
    """Files on disk against the index: ``on_disk``, ``indexed``, ``pending`` (not yet read), ``shallower`` (read less deeply)."""
    there = listing.select("path", F.lit(True).alias("_there")).distinct()
    joined = there.join(index.select("path", "depth", "status"), "path", "full_outer")
    here, known = F.col("_there").isNotNull(), F.col("status").isNotNull()
    return joined.agg(F.count_if(here).alias("on_disk"), F.count_if(known).alias("indexed"), F.count_if(here & ~known).alias("pending"), F.count_if(here & known & ~depth_covers(F.col("depth"), F.lit(wanted_depth))).alias("shallower"))


def library_records(index: DataFrame, tags: DataFrame) -> DataFrame:
    """Index rows with their tags: junk goes, blank titles become the file's stem, automatic tags are added."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    joined = index.where(F.col("kind") != "junk").join(tags.select("path", F.col("tags").alias("_tags")), "path", "left")
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", stem).otherwise(F.col("title"))
    return joined.withColumns({"title": title, "tags": split_tags(F.col("_tags")), "auto_tags": auto_tags(F.col("journal"), F.col("arxiv_id"), F.col("status"))}).drop("_tags")


def judged_scores(replies: DataFrame, batch: DataFrame) -> DataFrame:
    """Scores of a judge's replies: ``id``, ``score`` 0..1, ``reason`` of at most 120 characters.

    ``replies`` has ``n`` (order) and ``scores`` (array of id, score, reason as text); ids
    that weren't asked for and scores that aren't numbers go, later duplicates win.
    """
    each = replies.select("n", F.posexplode("scores").alias("i", "s")).select("n", "i", F.col("s.id").alias("id"), judged(F.col("s.score")).alias("score"), F.substring("s.reason", 1, 120).alias("reason"))
    last = F.struct("n", "i")
    return each.where("score is not null").join(batch.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by("score", last).alias("score"), F.max_by("reason", last).alias("reason"))
