"""Tables with further columns of clashing names, and what is written or listed beside the queries."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenlit.llm import binary_search, dialogue, hmm, merkle, packing, shuffling, token_counts

CLASHING = ("row", "key", "n", "symbol", "n_tokens", "score", "block", "asked", "rank", "tree", "position", "members", "Text_", "cell", "_text", "digest", "lot", "kind", "initial", "mark")


def cluttered(df, *taken):
    """A table with columns that operators use as names of their own."""
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in taken})


def test_language_scores_don_t_mind_other_columns(spark, rows):
    df = spark.createDataFrame([(i, t, k % 3 > 0) for k, (i, t, *_) in enumerate(rows[:40])], "doc_id long, text string, training boolean")
    names = ["doc_id", "n_tokens", "n_known", "base_score"]
    told = lambda d: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in hmm.language_scores(d)[0].select(names).collect())
    assert told(cluttered(df)) == told(df)


def test_nearest_codes_don_t_mind_other_columns(spark):
    df = spark.createDataFrame([(i, i * 0x9E3779B97F4A7C15 % (1 << 63)) for i in range(200)] + [(None, 5), (7, None)], "id long, code long")
    told = lambda d: Counter(map(tuple, binary_search.top_k(d.where("id % 50 = 0"), d, 3).collect()))
    assert told(cluttered(df)) == told(df) and sum(told(df).values()) == 12


def test_new_operators_don_t_mind_other_columns(spark, rows, turns):
    import public_tokenizers

    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows[:40]], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = lambda d: Counter(map(tuple, token_counts.token_counts(d, path).collect()))
    assert counts(cluttered(docs)) == counts(docs)
    leaves = docs.select((F.col("doc_id") % 3).alias("tree"), F.col("doc_id").alias("id"), merkle.leaf(F.col("text")).alias("digest"))
    leaves = leaves.withColumn("claim", F.col("digest"))
    told = lambda d: Counter(map(tuple, merkle.manifest(d).collect()))
    assert told(cluttered(leaves, "tree", "digest")) == told(leaves)
    some = spark.createDataFrame(turns[:60], "conv_id long, turn long, role string, text string")
    repaired = lambda d: Counter(map(tuple, dialogue.repaired(dialogue.damaged(d), d.select("conv_id").distinct()).collect()))
    assert repaired(cluttered(some)) == repaired(some)


@pytest.mark.parametrize("n", [0, 500])
def test_shards_are_written_in_slot_order(spark, tmp_path, n):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(n)], "doc_id long, text string").withColumn("size", F.length("text") + 1)
    dealt = shuffling.shards(shuffling.external_shuffle(df, "doc_id", "size", bucket_bytes=1 << 10), 3)
    shuffling.write_shards(dealt, str(tmp_path / "out"))
    if not n:
        return
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.shard, r.slot, r.doc_id) for r in back.collect()) == Counter((r.shard, r.slot, r.doc_id) for r in dealt.collect())
    files = back.select(F.input_file_name().alias("file"), "shard", "slot").collect()
    by = {}
    for r in files:
        by.setdefault(r.file, []).append((r.shard, r.slot))
    for held in by.values():  # a file has a run of slots of one shard, in order
        slots = [s for _, s in held]
        assert len({s for s, _ in held}) == 1 and slots == list(range(slots[0], slots[0] + len(slots)))


def test_the_manifest_of_packed_sequences(spark):
    rows = [(s, o, 10 * s + o, 0, 5) for s in range(3) for o in (0, 5, 10)]
    df = spark.createDataFrame(rows, "sequence_id long, offset long, doc_id long, start long, length long")
    told = {r.sequence_id: (r.used, [tuple(p) for p in r.pieces]) for r in packing.manifest(df).collect()}
    assert told == {s: (15, [(o, 10 * s + o, 0, 5) for o in (0, 5, 10)]) for s in range(3)}
