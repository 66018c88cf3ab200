"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm import binary_search, dialogue, hmm, media, merkle, mixing, packing, quality, shuffling, simhash, substrings, templates, token_counts
from lumenlit.llm.common import documents, salt_of_doc, ship
from lumenlit.session import spread

ORACLE_SQL: dict[str, str] = {}


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.pad(F.col("text")).alias("payload"))
    stored = docs.select("doc_id", "n_bytes", media.store(F.col("payload")).alias("media"))
    told = stored.withColumn("told", media.describe(F.col("media")))
    back = told.withColumn("back", media.read_back(F.col("media"), F.col("told.media_ranges")))
    ranges = F.crc32(F.to_json("told.keyframe_ranges"))
    feature = F.concat_ws("|", "told.codec", "told.timescale", "told.duration", "told.samples", "told.chunks", "told.keyframes", ranges)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("back").cast("long").alias("payload_bytes"),
        F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.substring("back", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        (F.col("told.duration") / F.col("told.timescale")).alias("seconds"),
        F.col("told.keyframes").alias("keyframes"),
    )


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", (salt_of_doc() != 1).alias("training"))
    scores, lexicon, _ = hmm.language_scores(docs)
    return scores.select("doc_id", (salt_of_doc() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = documents(spark, sf_dir).select("doc_id", "text", size.alias("size"))
    dealt = shuffling.shards(shuffling.external_shuffle(docs, "doc_id", "size"), 8)
    return dealt.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "bucket",
        "position",
    )


def op4_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(salt_of_doc() != 0).select("doc_id", F.col("quality").alias("label"))
    field = quality.train(docs, labels)
    scored = quality.scored(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", (salt_of_doc() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substrings.substring_dedup(documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL["op8_source_mix"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS w FROM sized GROUP BY source
), fill(round, capped) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT round + 1, (SELECT list(coalesce(source, chr(0)) ORDER BY source) FROM sums WHERE list_contains(capped, coalesce(source, chr(0))) OR 3 * s <= w * (
      (SELECT sum(s) FROM sums) - (SELECT coalesce(sum(3 * s), 0) FROM sums WHERE list_contains(capped, coalesce(source, chr(0)))))
      / (SELECT sum(w) FROM sums WHERE NOT list_contains(capped, coalesce(source, chr(0)))))
  FROM fill WHERE round < 40
), last AS (
  SELECT coalesce(capped, CAST([] AS VARCHAR[])) AS capped FROM fill ORDER BY round DESC LIMIT 1
), level AS (
  SELECT ((SELECT sum(s) FROM sums) - coalesce(sum(3 * s) FILTER (list_contains(capped, coalesce(source, chr(0)))), 0)) / sum(w) FILTER (NOT list_contains(capped, coalesce(source, chr(0)))) AS l
  FROM sums, last
), targets AS (
  SELECT source, s, CASE WHEN list_contains(capped, coalesce(source, chr(0))) THEN 3 * s ELSE w * l END AS target FROM sums, last, level
), rated AS (
  SELECT d.doc_id, d.size, CAST(t.s AS BIGINT) AS source_size, t.target, CASE WHEN t.s > 0 THEN least(3.0, t.target / t.s) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(size * (floor(rate) + CAST(u < rate - floor(rate) AS INT)) AS BIGINT) AS taken FROM rated
"""

def op9_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = templates.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.length("text").alias("kept_chars"))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    codes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), binary_search.signs(F.col("embedding")).alias("code"))
    return binary_search.top_k(codes.where("id % 100 = 0"), codes)


ORACLE_SQL["op10_multi_index_hashing"] = """
WITH codes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.id AS query_id, r.id AS neighbor_id, CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CAST(z[1] <> z[2] AS INT))) AS INT) AS distance
  FROM codes q JOIN codes r ON q.id % 100 = 0 AND r.id <> q.id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank, neighbor_id, distance
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = merkle.leaf(*fields, F.col("text"))
    claim = F.when(tampered, merkle.leaf(*fields, lowered)).otherwise(leaf)
    leaves = documents(spark, sf_dir).select(F.col("source").alias("tree"), F.col("doc_id").alias("id"), leaf.alias("digest"), claim.alias("claim"))
    told = merkle.manifest(leaves)
    return told.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return dialogue.repaired(dialogue.damaged(turns), turns.select("conv_id").distinct())


def _crc_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda u, i: {bit})), 4294967295)"


def _manifest_sql(depth: int = 4) -> str:
    """Trees of ``16 ** depth`` leaves at most, level by level."""
    told = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _crc_sql("CAST(doc_id AS VARCHAR)")
    ctes = [
        f"d AS (SELECT doc_id, source, sha256({head} || {told('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {told(lower)}) END AS tampered FROM documents)",
        "p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS rid FROM d)",
        "a0 AS (SELECT s AS tree, idx AS pos, n, leaf AS h FROM p)"]
    # Nodes of each level; a tree that has one node left keeps it.
    grow = lambda k, x: f"{x}{k + 1} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {x}{k} GROUP BY tree, pos // 16, n)"
    ctes += [grow(k, "a") for k in range(depth)]
    ctes.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{depth})")
    ctes += [grow(k, "b") for k in range(depth)]
    ctes.append("c0 AS (SELECT rid, s AS tree, idx, s, coalesce(tampered, leaf) AS f, '' AS sib FROM p)")
    for k in range(2 * depth):
        x, j = ("a", k) if k < depth else ("b", k - depth)
        if k == depth:
            ctes.append(f"e0 AS (SELECT rid, 0 AS tree, s AS idx, s, f, sib FROM c{k})")
        src = f"c{k}" if k != depth else "e0"
        ctes.append(f"c{k + 1} AS (SELECT c.rid, c.tree, c.idx // 16 AS idx, c.s, CASE WHEN any_value(l.n) = 1 THEN c.f ELSE sha256(string_agg(CASE WHEN l.pos = c.idx THEN c.f ELSE l.h END, '' ORDER BY l.pos)) END AS f, c.sib || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos <> c.idx), '') AS sib FROM {src} c JOIN {x}{j} l ON l.tree = c.tree AND l.pos // 16 = c.idx // 16 GROUP BY c.rid, c.tree, c.idx, c.s, c.f, c.sib)")
    return "WITH " + ", ".join(ctes) + f" SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(c.sib) AS proof_sha256, c.f AS folded_root, c.f = t.h AS verified FROM p JOIN c{2 * depth} c USING (rid) JOIN a{depth} r ON r.tree = p.s CROSS JOIN b{depth} t"


ORACLE_SQL["op11_merkle_manifest"] = _manifest_sql()


def _repair_sql() -> str:
    """The cheapest edits by a table over (turns done, state), a turn in each round."""
    crc = _crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    def f(k, cost, letter):  # twelve digits of cost, then the audit: the least text is the cheapest, then the least audit
        return f"printf('%012d', CAST(left({k}, 12) AS BIGINT) + {cost}) || substr({k}, 13) || '{letter}'"
    x2 = f"least(s2, {f('s0', 3, 'I')}, {f('s1', 3, 'I')}, {f('s3', 3, 'I')})"
    closed = lambda src: f"SELECT *, least(s3, {f('t2', 3, 'I')}) AS t3 FROM (SELECT *, {x2} AS t2 FROM {src})"
    may = "r.kind NOT IN ('blank', 'duplicate')"
    e = "CASE WHEN r.kind = 'truncated' THEN 3 ELSE 0 END"
    k = lambda s, on: f"CASE WHEN {may} AND r.i = '{on}' THEN {f(s, e, 'K')} END"
    r = lambda s: f"CASE WHEN {may} THEN {f(s, '3 + ' + e, 'R')} END"
    new = {
        "s0": f("s0", 4, "D"),
        "s1": f"least({f('s1', 4, 'D')}, {k('s0', 's')})",
        "s2": f"least({f('t2', 4, 'D')}, {k('s0', 'u')}, {k('s1', 'u')}, {k('t3', 'u')}, {r('s0')}, {r('s1')}, {r('t3')})",
        "s3": f"least({f('t3', 4, 'D')}, {k('t2', 'a')}, {r('t2')})",
    }
    step = ", ".join(f"{v} AS {n}" for n, v in new.items())
    trimmed = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS lot FROM conversations) WHERE lot <> 0
), everyone AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT e.c, d.turn, d.role, d.text, row_number() OVER (PARTITION BY e.c ORDER BY d.turn NULLS FIRST, d.role, sha256(d.text)) AS p, {trimmed} AS said FROM damaged d JOIN everyone e ON d.conv_id IS NOT DISTINCT FROM e.conv_id
), rows AS (
  SELECT *, left(role, 1) AS i, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind, left(lag(role) OVER (PARTITION BY c ORDER BY p), 1) || left(role, 1) AS pair FROM placed
), counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY c
), walk(c, p, s0, s1, s2, s3) AS (
  SELECT c, CAST(0 AS BIGINT), '000000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM counted
  UNION ALL
  SELECT w.c, w.p + 1, {step} FROM ({closed("walk")}) w JOIN rows r ON r.c = w.c AND r.p = w.p + 1
), best AS (
  SELECT w.c, least(s0, t3) AS k FROM ({closed("walk")}) w JOIN counted n ON n.c = w.c AND n.n = w.p
), told(c, audit, z, p, state, said) AS (
  SELECT c, substr(k, 13), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST([] AS VARCHAR[]) FROM best
  UNION ALL
  SELECT t.c, t.audit, t.z + 1, t.p + CAST(substr(t.audit, t.z + 1, 1) <> 'I' AS INT),
    CASE WHEN substr(t.audit, t.z + 1, 1) = 'D' THEN t.state WHEN substr(t.audit, t.z + 1, 1) = 'K' AND r.i = 's' THEN 1 WHEN t.state = 2 THEN 3 ELSE 2 END,
    CASE substr(t.audit, t.z + 1, 1) WHEN 'D' THEN t.said WHEN 'K' THEN list_append(t.said, r.role || ':' || r.text) WHEN 'R' THEN list_append(t.said, CASE WHEN t.state = 2 THEN 'assistant:' ELSE 'user:' END || r.text) ELSE list_append(t.said, CASE WHEN t.state = 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM told t LEFT JOIN rows r ON r.c = t.c AND r.p = t.p + 1 WHERE t.z < length(t.audit)
)
SELECT e.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(CAST(left(b.k, 12) AS BIGINT), 0) AS cost, coalesce(t.audit, '') AS audit, sha256(coalesce(array_to_string(t.said, chr(10)), '')) AS repaired_sha256
FROM everyone e LEFT JOIN counted n USING (c) LEFT JOIN best b USING (c) LEFT JOIN told t ON t.c = e.c AND t.z = length(t.audit)"""


ORACLE_SQL["op13_conversation_repair"] = _repair_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_hidden_markov_scores": op2_hidden_markov_scores,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_column_generation_packing": op4_column_generation_packing,
    "op5_simhash_components": op5_simhash_components,
    "op6_crf_quality": op6_crf_quality,
    "op7_fixed_block_anchors": op7_fixed_block_anchors,
    "op8_source_mix": op8_source_mix,
    "op10_multi_index_hashing": op10_multi_index_hashing,
    "op9_log_template_lines": op9_log_template_lines,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}
