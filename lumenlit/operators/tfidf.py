"""TF-IDF as long tables: one row for each document and term.

Weights are smooth idf times sublinear tf, L2-normalised: idf = ln((n + 1) / (df + 1)) + 1
and tf = 1 + ln(count). Only the term table grows with the text, and it is aggregated by
(document, term) before anything is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlit.functions.text import grams, strip_latex, tokens
from lumenlit.operators import nearest, packed_terms
from lumenlit.operators.graph import shared_folder


# Words that never become keywords of a profile.
PROFILE_STOPS = (
    "a an the of and or for in on to with by from at as is are was were be been being this that these those it its we our us they their them he she his her not no nor"
    " but if then than so such can could may might will would shall should do does did have has had using used use new novel two three one via under over between within"
    " results result show shows shown study studies paper present presents presented however thus therefore also more most less least very much many few all any both"
    " each other others into out up down about which who whom whose what when where why"
).split()


@dataclass(frozen=True)
class Config:
    """A named way to fit: how much of the vocabulary stays."""

    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None


# The two fits.
RELEVANCE, KEYWORDS = Config(), Config(min_df=2, max_features=400)


def english_stop_words(path: str | None = None) -> list[str]:
    """Spark's own English list, or the words of a text file (one or more a line) where a longer list is wanted."""
    if path is not None:
        spark = SparkSession.active()
        return sorted({w for r in spark.read.text(path).collect() for w in r["value"].split()})
    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w]


def term_counts(docs: DataFrame, doc_id: str, text: Column, stop: list[str] | None = None, pairs: bool = True) -> DataFrame:
    """``doc``, ``term``, ``n``.

    Texts are dealt out by document before they are taken apart, so a document's terms are
    counted where they are made: its text crosses the network, and not every one of its terms.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as texts are small beside their terms
    dealt = docs.select(F.col(doc_id).alias("doc"), text.alias("_text")).repartition(parts, "doc")
    terms = dealt.select("doc", F.explode(grams(tokens(F.col("_text")), stop or [], pairs)).alias("term"))
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def by_term(counts: DataFrame) -> DataFrame:
    """The counts dealt out by term, so that what is summed over a term and what is joined to it read one exchange of one count.

    For fits that keep most terms; a small vocabulary is broadcast and needs no exchange of all counts.
    """
    return counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term")


def _documents() -> Column:
    """Documents of a term; reads all columns of the counts, so that a sum and a join of them are of one exchange."""
    return F.count(F.when(F.col("n") > 0, F.hash("doc")))


class NothingLeft(ValueError):
    """No term is left of a fit's documents, or none could be."""


@dataclass(frozen=True)
class Fitted:
    """``vocabulary``: term, df, tf, idf; ``n_docs`` counts all documents, with or without terms."""

    vocabulary: DataFrame
    n_docs: int

    def required(self) -> Fitted:
        """The fit, or an error if no term is left; looks for one row, where a plan alone says nothing."""
        if self.vocabulary.isEmpty():
            raise NothingLeft("no term is left: lower min_df or raise max_df")
        return self

    def transform(self, counts: DataFrame) -> DataFrame:
        """``doc``, ``term``, ``w``: normalised weights; terms outside the vocabulary are dropped."""
        raw = counts.join(self.vocabulary.select("term", "idf"), "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
        # The window holds one document's terms, and takes one shuffle where a join with the norms would take two.
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
        return raw.select("doc", "term", (F.col("w") / norm).alias("w"))


def fit(counts: DataFrame, n_docs: int, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None) -> Fitted:
    """Whole numbers bound document counts, fractions shares; ties in ``max_features`` go to the smaller term.

    Bounds that exclude each other are an error at once; an empty vocabulary is one if it is ``required``.
    """
    bound = lambda x: x * n_docs if isinstance(x, float) else x
    if n_docs and bound(max_df) < bound(min_df):
        raise NothingLeft("max_df allows fewer documents than min_df asks for")
    terms = counts.groupBy("term").agg(_documents().alias("df"), F.sum("n").alias("tf"))
    terms = terms.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))
    if max_features is not None:
        terms = terms.orderBy(F.desc("tf"), "term").limit(max_features)
    return Fitted(terms.withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1), n_docs)


def fitted(counts: DataFrame, n_docs: int, config: Config) -> Fitted:
    return fit(counts, n_docs, config.min_df, config.max_df, config.max_features)


def library_text(title: Column, abstract: Column, context: Column, tags: Column) -> Column:
    """A library paper's words for retrieval: all it has, tags included, lower-cased without LaTeX."""
    parts = [F.nullif(c, F.lit("")) for c in (title, abstract, context)] + [F.nullif(F.array_join(tags, " "), F.lit(""))]
    return F.lower(strip_latex(F.concat_ws(" ", *parts)))


def relevance(profile: str, docs: DataFrame, doc_id: str, text: Column, stop: list[str] | None = None, pairs: bool = True) -> DataFrame:
    """``doc``, ``relevance``: cosine with the profile, over the largest, to the power 0.7.

    The profile is a row of the fit. An empty profile gives 0.5 to all, no overlap 0.0.
    Document norms need the whole vocabulary, whose counts are packed; the profile's terms
    (a few hundred at most) go to every task. Ids are unique.
    """
    n_docs = docs.count() + 1
    spark = docs.sparkSession
    stop = english_stop_words() if stop is None else stop
    query = spark.range(1).select(F.lit(-1).cast("long").alias("doc"), F.lit(profile).alias("t"))
    own = {r["term"]: r["n"] for r in term_counts(query, "doc", F.col("t"), stop, pairs).collect()}
    if not own:
        return docs.select(F.col(doc_id).alias("doc"), F.lit(0.5).alias("relevance"))
    # Texts are dealt out as in ``term_counts``.
    dealt = docs.select(F.col(doc_id).alias("doc"), text.alias("_text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    dots = packed_terms.profile_sums(dealt.select("doc", tokens(F.col("_text")).alias("words")), n_docs, own, stop, pairs).withColumn("norm", F.sqrt("squares"))
    cosine = F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(0.0)
    base = docs.select(F.col(doc_id).alias("doc")).join(dots.select("doc", cosine.alias("c")), "doc", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    shared_folder(base)
    base = base.checkpoint()  # two numbers a document, read for the largest and for all
    top = base.agg(F.max("c").alias("top"))
    scaled = F.least(F.lit(1.0), F.pow(F.col("c") / F.col("top"), F.lit(0.7)))
    return base.crossJoin(F.broadcast(top)).select("doc", F.when(F.col("top") > 0, F.round(scaled, 4)).otherwise(0.0).alias("relevance"))


def top_terms(weights: DataFrame, n_pairs: int, n_words: int) -> DataFrame:
    """The heaviest pairs, then the heaviest words, by column sum (rounded, ties by term)."""
    sums = weights.groupBy("term").agg(F.round(F.sum("w"), 6).alias("weight")).withColumn("is_pair", F.col("term").contains(" "))
    rank = F.row_number().over(Window.partitionBy("is_pair").orderBy(F.desc("weight"), "term"))
    return sums.withColumn("rank", rank).where(F.when(F.col("is_pair"), F.col("rank") <= n_pairs).otherwise(F.col("rank") <= n_words))


def related(queries: DataFrame, library: DataFrame, k: int = 8) -> DataFrame:
    """``doc``, ``neighbor``, ``rank``, ``similarity``: nearest library rows by cosine above 0, ties by smaller id.

    Both sides are weights of one fit; a row isn't its own neighbour. ``queries`` is a
    stated part of the rows, so a term's postings meet its few queries and no more.
    """
    other = library.select(F.col("doc").alias("neighbor"), "term", F.col("w").alias("lw"))
    pairs = queries.join(other, "term").where("doc <> neighbor").groupBy("doc", "neighbor").agg(F.round(F.sum(F.col("w") * F.col("lw")), 6).alias("similarity"))
    return _nearest(pairs.where("similarity > 0"), "doc", "similarity", k)


#: Rows of a block in a search by shared words, where a row has some words and not a text's.
SHORT_BLOCK = 50_000


def overlap_related(queries: DataFrame, library: DataFrame, k: int = 8) -> DataFrame:
    """The same by the number of shared words of four letters or more; both sides have ``doc`` and ``words`` (distinct).

    Blocks of rows answer the queries that are streamed past them, so no pair of rows is shuffled or kept.
    """
    weighed = lambda df: df.select("doc", F.explode("words").alias("term"), F.lit(1.0).alias("w"))
    return nearest.nearest(weighed(queries), weighed(library), k, SHORT_BLOCK).select("doc", "neighbor", F.col("similarity").cast("long").alias("shared"), "rank")


def _nearest(pairs: DataFrame, query: str, by: str, k: int) -> DataFrame:
    """The first ``k`` of each query; Spark keeps as many of each task's before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(by), "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that are compared with a block of vectors at once, and vectors in a block.
QUERIES, BLOCK = 2_000, 100_000


def vector_related(queries: DataFrame, vectors: DataFrame, k: int = 8, block: int = BLOCK) -> DataFrame:
    """Nearest vectors by cosine for a stated set of queries, which may grow with the table.

    Both have ``id`` and ``v``; a vector isn't its own neighbour. Vectors are cut into
    blocks, each sent once; queries are sent to every block and streamed past it in
    matrices of bounded size, and a block gives its ``k`` best of each query (rounded to
    six places, ties by smaller id), so the best of all blocks are exact.
    """
    blocks = max(1, -(-vectors.count() // block))
    usable = lambda df: df.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    held = usable(vectors).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("asked"), "id", "v")
    asked = usable(queries).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asked"), "id", "v")
    met = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, matrix = None, [], None
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        for batch in batches:
            block, asked, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asked", "id"))
            cut = np.append(np.flatnonzero(np.diff(block * 2 + asked, prepend=-1)), len(block))
            for i, j in ((a, min(a + QUERIES, j)) for i, j in zip(cut[:-1], cut[1:], strict=True) for a in range(i, j, QUERIES)):
                rows = unit(np.stack(batch.column("v").slice(i, j - i).to_numpy(zero_copy_only=False)))
                if block[i] != now:
                    now, held, matrix = block[i], [], None
                if not asked[i]:
                    held.append((ids[i:j], rows))
                    continue
                if not held:
                    continue
                if matrix is None:
                    own, matrix = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(own)
                    own, matrix = own[order], matrix[order]
                out: list[tuple[int, int, float]] = []
                step = max(1, 8_000_000 // len(own))
                for a in range(0, j - i, step):
                    near = np.round(rows[a : a + step] @ matrix.T, 6) + 0.0
                    near[own[None, :] == ids[i + a : i + a + step, None]] = -np.inf
                    for q, line in zip(ids[i + a : i + a + step].tolist(), near, strict=True):
                        least = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                        some = np.flatnonzero((line >= least) & (line > -np.inf))
                        some = some[np.argsort(-line[some], kind="stable")][:k]
                        out += [(q, int(own[x]), float(line[x])) for x in some]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "neighbor", "similarity"])

    return _nearest(met.mapInArrow(search, "query_id long, neighbor long, similarity double"), "query_id", "similarity", k)
