"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code falls into four segments of 16 bits. Codes within distance r of a query
agree with it in some segment up to floor(r / 4) bits, so a query looks up, segment after
segment, all values at growing radius; once the lookups up to radius s in the first j + 1
segments and s - 1 in the rest are done, every code within 4 s + j has been seen, and the
search ends when the kth verified distance is no more than that.

Rows are cut into blocks of bounded size by hash, and each row is sent once, to its
block. A task indexes a block and streams the queries past it, which are sent to every
block; the k best of all blocks are the exact answer, since each block's answer is exact.
Nothing is capped or approximated.

Defined results: null vectors have no code and are neither found nor searched; a row is
not its own neighbour (rows are told apart by id, so repeated ids are neighbours of no
row of that id); ties go to the smaller id; fewer rows than k give what there is; an
empty table gives an empty one; other columns, whatever their names, are neither read
nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS, WIDTH = 4, 16
K = 10
#: Rows in a block, on average.
BLOCK = 250_000
_masks: dict[int, np.ndarray] = {}


def signs(vector: Column) -> Column:
    """The 64-bit code of a vector: bit i is set if component i is above 0 (components over 64 are folded by parity)."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    if radius not in _masks:
        _masks[radius] = np.array([sum(1 << i for i in c) for c in combinations(range(WIDTH), radius)] or [0], np.int64)
    return _masks[radius]


class Index:
    """Rows of a block by the value of each segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray) -> None:
        self.codes, self.ids = codes, ids
        self.order, self.start = [], []
        for s in range(SEGMENTS):
            value = (codes >> np.uint64(s * WIDTH)).astype(np.int64) & (1 << WIDTH) - 1
            self.order.append(np.argsort(value, kind="stable"))
            self.start.append(np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << WIDTH)))))

    def rows(self, segment: int, values: np.ndarray) -> np.ndarray:
        a, b = self.start[segment][values], self.start[segment][values + 1]
        n = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return self.order[segment][at]

    def nearest(self, code: np.uint64, own: int, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id), grown until the kth is covered."""
        seen = np.zeros(len(self.codes), bool)
        far, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                value = int(code >> np.uint64(s * WIDTH)) & (1 << WIDTH) - 1
                rows = self.rows(s, value ^ masks(radius))
                rows = rows[~seen[rows]]
                seen[rows] = True
                rows = rows[self.ids[rows] != own]
                far = np.concatenate((far, np.bitwise_count(self.codes[rows] ^ code).astype(np.int64)))
                ids = np.concatenate((ids, self.ids[rows]))
                # A row not seen differs in more than radius bits of the first s + 1 segments, in radius or more of the others.
                if len(far) >= k and np.partition(far, k - 1)[k - 1] <= SEGMENTS * radius + s:
                    best = np.lexsort((ids, far))[:k]
                    return list(zip(far[best].tolist(), ids[best].tolist(), strict=True))
        best = np.lexsort((ids, far))[:k]
        return list(zip(far[best].tolist(), ids[best].tolist(), strict=True))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Answers of each block, whose rows come before its queries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, index = None, None
    for batch in batches:
        block, asked, ids, codes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asked", "id", "code"))
        cut = np.append(np.flatnonzero(np.diff(block * 2 + asked, prepend=-1)), len(block))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if block[i] != now:
                held, now, index = [], block[i], None
            if not asked[i]:
                held.append((codes[i:j].view(np.uint64), ids[i:j]))
                continue
            if not held:  # a block without rows
                continue
            if index is None:
                index = Index(*(np.concatenate(x) for x in zip(*held, strict=True)))
            found = [(q, c, d, x) for q, c in zip(ids[i:j].tolist(), codes[i:j], strict=True) for d, x in index.nearest(c.view(np.uint64), q, k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in zip(*found, strict=True)], ["query_id", "code", "distance", "neighbor_id"])


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``neighbor_id``, ``distance`` of the k nearest rows of each query.

    Both tables have ``id`` long and ``code`` long; queries with equal ids are one query if their codes agree.
    """
    rows = rows.where("id is not null and code is not null").select("id", "code")
    queries = queries.where("id is not null and code is not null").select("id", "code").distinct()
    blocks = max(1, -(-rows.count() // block))
    number = F.pmod(F.xxhash64(F.col("id"), F.monotonically_increasing_id()), F.lit(blocks))
    held = rows.select(number.alias("block"), F.lit(0).alias("asked"), "id", "code")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asked"), "id", "code")
    met = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asked")
    found = met.mapInArrow(lambda batches: _search(batches, k), "query_id long, code long, distance long, neighbor_id long")
    order = Window.partitionBy("query_id", "code").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))
