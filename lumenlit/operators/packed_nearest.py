"""Nearest documents by the weights of all their terms, for those that are asked about.

Slices get their weights as in ``packed_weights``; a block is made of some slices and keeps only
terms that a document asked about has, as no other adds to a similarity (lengths count all
terms). Documents that are asked about are sent to every block as counts, a slice of them at a time.
In a block, terms that many rows have are a matrix, which a slice meets as a product of
matrices; the others are postings, which are summed for each document asked about. So every
shared term counts, no pair of rows is shuffled or kept, and a block gives its ``k`` best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.operators import packed_weights as packed
from lumenlit.operators.graph import shared_folder
from lumenlit.operators.packed_terms import _numbers, _planes

#: Documents of a block; the share of its rows from which on a term is a column of its matrix, and columns at most.
BLOCK, COMMON, COLUMNS = 40_000, 0.1, 400
#: Similarities are rounded to six places, so a bound on the kth holds less this.
SLACK = 2e-6
_PARTS = ("ids", "digest", "df", "runs", "at", "n", "norm")


def useful(s: packed.Slice, x: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
    """Of a slice's terms that others can share with a document that is asked about, ascending: digests, document counts, how many documents of the slice have each, their places and counts; and each document's length."""
    df = x // 2
    w = (1 + np.log(s.n)) * np.repeat(packed.idf(n_docs, df), s.runs)
    norm = np.sqrt(np.bincount(s.at, w * w, len(s.docs)))
    which = s.order[((x % 2 == 1) & (df > 1))[s.order]]
    runs, start = s.runs[which], (np.cumsum(s.runs) - s.runs)[which]
    move = np.repeat(start - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    return s.digest[which, 0], df[which], runs, s.at[move], s.n[move], norm


def weighed(n_docs: int, df: np.ndarray, runs: np.ndarray, at: np.ndarray, n: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1 + np.log(n)) * np.repeat(packed.idf(n_docs, df), runs) / norm[at]


class Block:
    """Rows of some slices: the matrix of common terms, and the postings of the others."""

    def __init__(self, slices: list[tuple[np.ndarray, ...]]) -> None:
        ids, digest, runs, at, w = zip(*slices, strict=True)
        self.ids = np.concatenate(ids)
        self.by = np.argsort(self.ids)
        self.terms, term = np.unique(np.concatenate(digest), return_inverse=True)
        term = np.repeat(term.astype(np.int32), np.concatenate(runs))
        row = np.concatenate([a.astype(np.int32) + b for a, b in zip(at, np.cumsum([0, *map(len, ids[:-1])]), strict=True)]).astype(np.int32)
        many = np.bincount(term, minlength=len(self.terms))
        common = np.flatnonzero(many >= max(2, COMMON * len(self.ids)))
        common = common[np.argsort(-many[common], kind="stable")][:COLUMNS]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[common] = np.arange(len(common))
        order = np.argsort(term, kind="stable")
        self.row, self.w = row[order], np.concatenate(w)[order]
        self.first = np.append(0, np.cumsum(many))
        self.matrix = np.zeros((len(common), len(self.ids)))
        for i, t in enumerate(common.tolist()):
            a, b = self.first[t], self.first[t + 1]
            self.matrix[i, self.row[a:b]] = self.w[a:b]

    def nearest(self, ids: np.ndarray, digest: np.ndarray, runs: np.ndarray, at: np.ndarray, w: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each asked document with the ids and similarities of its ``k`` best rows."""
        if not len(self.terms):
            return
        rows = len(self.ids)
        place = np.minimum(np.searchsorted(self.terms, digest), len(self.terms) - 1)
        met = np.repeat(self.terms[place] == digest, runs)
        term, at, w = np.repeat(place, runs)[met], at[met], w[met]
        column = self.column[term]
        asked = np.zeros((len(ids), len(self.matrix)))
        asked[at[column >= 0], column[column >= 0]] = w[column >= 0]
        rare = np.flatnonzero(column < 0)
        rare = rare[np.argsort(at[rare], kind="stable")]
        term, w = term[rare], w[rare]
        start, long = self.first[term], self.first[term + 1] - self.first[term]
        cut = np.searchsorted(at[rare], np.arange(len(ids) + 1))
        own = self.by[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by), rows - 1)]
        groups, step = np.arange(0, rows, 64), max(1, 8_000_000 // rows)
        for i in range(len(ids)):
            if i % step == 0:
                lines = asked[i : i + step] @ self.matrix
            line, j = lines[i % step], slice(cut[i], cut[i + 1])
            each = long[j]
            if len(each):
                ranges = [slice(a, b) for a, b in zip(start[j].tolist(), (start[j] + each).tolist(), strict=True)]
                read, held = (np.concatenate([c[r] for r in ranges]) for c in (self.row, self.w))
                line += np.bincount(read, held * np.repeat(w[j], each), rows)
            if self.ids[own[i]] == ids[i]:
                line[own[i]] = 0.0
            most = np.maximum.reduceat(line, groups)
            least = max(0.0, np.partition(most, -k)[-k] - SLACK) if len(most) >= k else 0.0
            some = np.flatnonzero((line >= least) & (line > 0))
            near = np.round(line[some], 6)
            some, near = self.ids[some[near > 0]], near[near > 0]
            best = np.lexsort((some, -near))[:k]
            yield int(ids[i]), some[best], near[best]


def nearest(docs: DataFrame, n_docs: int, stop: list[str], pairs: bool = True, k: int = 8) -> DataFrame:
    """``doc``, ``neighbor``, ``rank``, ``similarity``: nearest documents by cosine above 0 for those that are ``asked`` about, ties by smaller id.

    ``docs`` has ``doc``, ``words`` and ``asked``; all its rows are searched, by all their terms. A document without an id counts in the fit alone.
    """
    spark = docs.sparkSession
    stops, shares = set(stop), packed.shares_of(docs, n_docs)
    parts, blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-n_docs // BLOCK))
    shared_folder(docs)
    said = packed.said(docs.withColumn("doc", F.col("doc").cast("long")), n_docs, stop, pairs).checkpoint()  # read for what is asked and for the blocks

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, x in packed.told(batches, stops, pairs, shares):
            digest, df, runs, at, n, norm = useful(s, x, n_docs)
            parts = s.docs.to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), digest.tobytes(), *map(_planes, (df, runs, at, n)), norm.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], list(_PARTS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, held, block = None, [], [], None
        for batch in batches:
            number, late, kind = (batch.column(c).to_pylist() for c in ("block", "late", "kind"))
            for i in range(batch.num_rows):
                if number[i] != now:
                    now, answers, held, block = number[i], [], [], None
                if not late[i] and not kind[i]:
                    answers.append(batch.column("x")[i].as_py())
                elif not late[i]:
                    s = packed.Slice.read(batch.column("x")[i].as_py(), stops, pairs, shares)
                    digest, *rest = useful(s, s.answered(answers), n_docs)
                    named, w, at, runs = s.docs.is_valid().to_numpy(zero_copy_only=False), weighed(n_docs, *rest), rest[2], rest[1]
                    if not named.all():
                        some = named[at]
                        runs = np.bincount(np.repeat(np.arange(len(runs)), runs)[some], minlength=len(runs))
                        at, w = (np.cumsum(named) - 1)[at[some]], w[some]
                    held.append((s.docs.drop_null().to_numpy(zero_copy_only=False), digest, runs, at, w))
                    answers = []
                else:
                    if block is None and held:
                        block, held = Block(held), []
                    if block is None:
                        continue
                    ids, digest, df, runs, at, n, norm = (batch.column(c)[i].as_py() for c in _PARTS)
                    ids, digest, norm = np.frombuffer(ids, np.int64), np.frombuffer(digest, np.uint64), np.frombuffer(norm)
                    df, runs, at, n = (_numbers(b).astype(np.int64) for b in (df, runs, at, n))
                    out = [(q, near, like) for q, near, like in block.nearest(ids, digest, runs, at, weighed(n_docs, df, runs, at, n, norm), k) if len(near)]
                    if out:
                        asked, near, like = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked, np.int64), [len(x) for x in near])), pa.array(np.concatenate(near).astype(np.int64)), pa.array(np.concatenate(like))], ["doc", "neighbor", "similarity"])

    by_slice = said.where("asked").repartitionById(parts, packed.dealt(parts)).sortWithinPartitions("slice", "kind", "part")
    wanted = by_slice.mapInArrow(asking, ", ".join(f"{c} binary" for c in _PARTS))
    none, each = F.lit(None).cast("binary"), F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = said.select(packed.dealt(blocks).alias("block"), F.lit(0).alias("late"), "slice", "kind", "part", "x", *(none.alias(c) for c in _PARTS))
    sent = wanted.select(F.explode(each).alias("block"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("slice"), F.lit(0).alias("kind"), F.lit(0).alias("part"), none.alias("x"), *_PARTS)
    met = rows.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "late", "slice", "kind", "part")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("similarity"), "neighbor"))
    best = met.mapInArrow(found, "doc long, neighbor long, similarity double")
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
