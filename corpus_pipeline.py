"""From raw documents to packed training sequences: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents`` alone, with ``n_chars`` following the text.

Defined results, for every stage: a null text is an empty one, but stays null where the
stage keeps the text; null ids, sources and languages are values like others; rows that
are equal are rows each, of which near-dedup keeps one; an empty table gives an empty one;
columns beyond those of ``documents``, whatever their names, go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm import mixing, near_copies, packing, quality, templates
from lumenlit.llm.common import drop_stored, salt_of_doc, ship, stored, stored_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; learnt without the held-out fifth of the labels.

    An empty or null text has a score like any other; without labels all have the prior's (0.5) and stay.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(salt_of_doc() != 0).select("doc_id", F.col("quality").alias("label"))
    field = quality.train(docs, labels)
    return quality.scored(docs, field).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but stay in their first document (the smallest id; null ids are last).

    Blank lines stay; a document that loses all its lines stays as an empty text; equal rows lose the same lines.
    """
    ship(spark)
    kept = templates.drop_recurring_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of documents linked by a similarity of 0.8 or more of five-word shingles.

    The one of smallest id (null ids last; ties by a hash of the text); texts without words are one group.
    """
    ship(spark)
    return near_copies.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate says, empty texts included; null is a source of its own."""
    sized = docs.withColumn("size", mixing.words(F.col("text")))
    return mixing.emit(mixing.mix(sized)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: a row for each, copies of a document each on their own; an empty text is its end token."""
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's tables are deleted when its result is written, but for the last result, which the returned rows are read from."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_tables()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))  # written and read again, as each stage reads its input more than once
        drop_stored(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
