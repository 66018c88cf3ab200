"""Nearest rows by sparse vectors, with bounds that leave most postings unread and lose nothing.

First a floor for each query: every term's heaviest postings alone (its champions) give
partial products with some rows, and as weights are never negative, the kth largest of them
is one that the kth neighbour has at least. Then rows are cut into blocks, whose postings are kept by
term with the largest weight of each term in the block, and queries are streamed past the
blocks. What some of a query's terms can reach in a block is bounded by its weights times
those maxima, and by the length of these weights times that of the longest row. A
block whose bound lies below the floor is skipped; else the terms with many postings and
little weight are set apart for as long as they stay below the floor together. Only the
postings of the others name candidates; the terms set apart are looked up for candidates
that still can pass, and each look-up tells more of them off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.session import ship

#: Heaviest postings of a term that make the floor, and rows in a block.
CHAMPIONS, BLOCK = 64, 10_000
#: Similarities are rounded to six places, so a floor holds less this.
SLACK = 1e-6


def floors(queries: DataFrame, library: DataFrame, k: int, champions: int = CHAMPIONS) -> DataFrame:
    """``doc``, ``floor``: a similarity that the query's kth neighbour has at least (queries without one are left out)."""
    wanted = library.join(queries.select("term").distinct(), "term", "left_semi")
    heavy = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "doc"))
    top = wanted.withColumn("n", heavy).where(F.col("n") <= champions).select("term", F.col("doc").alias("neighbor"), F.col("w").alias("lw"))
    partial = queries.join(top, "term").where("doc <> neighbor").groupBy("doc", "neighbor").agg(F.sum(F.col("w") * F.col("lw")).alias("least"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("least"), "neighbor"))
    return partial.withColumn("n", place).where(F.col("n") <= k).groupBy("doc").agg(F.min("least").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("doc", "floor")


class Block:
    """The postings of some rows by term: ascending rows, weights, and each term's largest weight."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.ids = np.array(ids, np.int64)
        order = np.argsort(self.ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = self.ids[order]
        flat, row, w = np.concatenate(terms), np.repeat(place, list(map(len, terms))), np.concatenate(weights)
        by = np.lexsort((row, flat))
        flat, self.row, self.w = flat[by], row[by], w[by]
        self.terms, first = np.unique(flat, return_index=True)
        self.first = np.append(first, len(flat))
        self.most = np.maximum.reduceat(self.w, first) if len(flat) else np.empty(0)
        self.longest = np.sqrt(np.bincount(row, w * w).max()) if len(flat) else 0.0

    def nearest(self, own: int, terms: np.ndarray, weights: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and similarities of the rows that may be among the ``k`` nearest, and how many postings were read of how many."""
        nothing = np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        some = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[some], weights[some]
        long = self.first[at + 1] - self.first[at]
        order = np.argsort(weights * weights / np.maximum(long, 1))  # first those with many postings and little weight
        at, weights, long = at[order], weights[order], long[order]
        # What the first terms can add together: by their largest weights, or by their length and the longest row's.
        bound = np.minimum(np.cumsum(weights * self.most[at]), np.sqrt(np.cumsum(weights * weights)) * self.longest)
        whole = int(long.sum())
        if not len(at) or bound[-1] < floor - SLACK:
            return *nothing, 0, whole
        weak = int(np.searchsorted(bound, floor - SLACK))  # so many terms don't reach the floor together
        score, read = np.zeros(len(self.ids)), int(long[weak:].sum())
        for i in range(weak, len(at)):
            a, b = self.first[at[i]], self.first[at[i] + 1]
            score[self.row[a:b]] += weights[i] * self.w[a:b]
        score[self.ids == own] = 0.0
        rows = np.flatnonzero(score)
        for i in range(weak - 1, -1, -1):
            held = score[rows]
            least = max(floor, np.partition(held, -k)[-k]) if len(rows) >= k else floor
            rows = rows[held + bound[i] >= least - SLACK]
            a, b = self.first[at[i]], self.first[at[i] + 1]
            place = np.minimum(np.searchsorted(self.row[a:b], rows), b - a - 1)
            hit = self.row[a:b][place] == rows
            score[rows[hit]] += weights[i] * self.w[a:b][place[hit]]
            read += min(len(rows), int(b - a))
        near = np.round(score[rows], 6)
        rows, near = rows[near > 0], near[near > 0]
        best = np.lexsort((rows, -near))[:k]
        return self.ids[rows[best]], near[best], read, whole


def searched(queries: DataFrame, library: DataFrame, k: int = 8, block: int = BLOCK, champions: int = CHAMPIONS) -> DataFrame:
    """``doc``, ``neighbor``, ``similarity`` of each block's nearest rows, and one row for each query and block
    without a neighbour: ``read``, the postings that were read, ``postings``, those that its terms have there.

    Both tables have ``doc``, ``term`` and ``w`` (0 or more). Terms are told apart by 64-bit hashes.
    """
    ship(library.sparkSession)
    held = library.groupBy("doc").agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("w").alias("weights"))
    blocks = max(1, -(-library.agg(F.count_distinct("doc")).first()[0] // block))
    asked = queries.groupBy("doc").agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("w").alias("weights")).join(floors(queries, library, k, champions), "doc", "left")
    rows = held.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"), F.lit(0).alias("asked"), "doc", F.lit(0.0).alias("floor"), "terms", "weights")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    met = rows.unionByName(asked.select(each, F.lit(1).alias("asked"), "doc", F.coalesce("floor", F.lit(0.0)).alias("floor"), "terms", "weights"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, lists = None, None, ([], [], [])
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if columns["block"][i] != now:
                    now, made, lists = columns["block"][i], None, ([], [], [])
                own, terms, weights = int(columns["doc"][i]), columns["terms"][i], columns["weights"][i]
                if not columns["asked"][i]:
                    for column, value in zip(lists, (own, terms, weights), strict=True):
                        column.append(value)
                    continue
                made = made or Block(*lists) if lists[0] else None
                if made is None:
                    continue
                ids, near, read, whole = made.nearest(own, terms, weights, columns["floor"][i], k)
                out += [(own, int(n), float(s), None, None) for n, s in zip(ids, near, strict=True)]
                out.append((own, None, None, read, whole))
            if out:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc", "neighbor", "similarity", "read", "postings"])

    return met.repartition("block").sortWithinPartitions("block", "asked").mapInArrow(work, "doc long, neighbor long, similarity double, read long, postings long")


def nearest(queries: DataFrame, library: DataFrame, k: int = 8, block: int = BLOCK) -> DataFrame:
    """``doc``, ``neighbor``, ``rank``, ``similarity``: nearest library rows by cosine above 0, ties by smaller id.

    The same rows as ``tfidf.related``, which reads every posting.
    """
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("similarity"), "neighbor"))
    found = searched(queries, library, k, block).where("neighbor is not null").select("doc", "neighbor", "similarity")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
