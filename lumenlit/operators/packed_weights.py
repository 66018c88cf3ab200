"""Weights of all terms of all documents, without a row for each document and term in a shuffle.

Texts go a slice at a time. A slice sends each share of the terms (by a digest) its terms and
how many of its documents have each; the share adds those up over all slices and answers each
with the sums, in the order it was asked. What a slice needs to count its terms again, its
words as numbers, goes the same way. So the network and the disks hold a slice's words, each of
its terms once, and the answers; weights are made where they are given out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.operators import packed_terms as packed
from lumenlit.session import ship

#: Words of a slice, and of one of documents that are asked about, and rows of a batch that is given out.
SLICE, ASKED_SLICE, OUT = 1_000_000, 250_000, 200_000
_SAID = "asked boolean, slice long, kind int, part int, x binary"
_COMPRESSED = pa.ipc.IpcWriteOptions(compression="zstd")


def _starts(ids: pa.Array) -> np.ndarray:
    """Where another document begins, of rows that are in order."""
    return np.flatnonzero(np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), prepend=-1))


def gathered(batches: Iterator[pa.RecordBatch], most: int, most_asked: int) -> Iterator[tuple[bool, pa.Array, pa.ListArray]]:
    """Slices of ``most`` words, or of one document; a document's rows follow one another and aren't parted. Those that are ``asked`` about are apart."""
    held: tuple[list, list] = ([], [])
    words_of, last = [0, 0], None

    def slice_(lane: int) -> tuple[bool, pa.Array, pa.ListArray]:
        taken = [(b, pa.array(i)) for b, i in held[lane]]
        held[lane].clear()
        words_of[lane] = 0
        return bool(lane), *(pa.concat_arrays([b.column(c).take(i) for b, i in taken]) for c in ("doc", "words"))

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = batch.column("doc"), batch.column("words")
        asked = batch.column("asked").fill_null(False).to_numpy(zero_copy_only=False)
        first = _starts(ids)
        ends, offsets = np.append(first[1:], batch.num_rows), words.offsets.to_numpy()
        same = last is not None and ids[0].as_py() == last[0]
        fresh: list[set] = [set(), set()]
        for a, b, n in zip(first.tolist(), ends.tolist(), (offsets[ends] - offsets[first]).tolist(), strict=True):
            lane = int(asked[a])
            if words_of[lane] and words_of[lane] + n > (most_asked if lane else most) and not (a == 0 and same):
                yield slice_(lane)
                fresh[lane].clear()
            if not fresh[lane]:
                fresh[lane].add(0)
                held[lane].append((batch, []))
            held[lane][-1][1].extend(range(a, b))
            words_of[lane] += n
        last = (ids[-1].as_py(),)
    for lane in (0, 1):
        if held[lane]:
            yield slice_(lane)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^64 by their first bytes, their second bytes, ..., which compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _steps(b: bytes) -> np.ndarray:
    """Ascending numbers from the planes of the first and of their differences."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _written(ids: pa.Array, words: pa.Array, lengths: np.ndarray, stop: set[str]) -> bytes:
    """A slice's words without stop words, as numbers, the most frequent first, which compress well as planes."""
    told = words.dictionary_encode()
    code = told.indices.to_numpy(zero_copy_only=False)
    keep = ~np.fromiter((w in stop for w in told.dictionary.to_pylist()), bool, len(told.dictionary))[code]
    code, lengths = code[keep], np.bincount(np.repeat(np.arange(len(lengths)), lengths)[keep], minlength=len(lengths))
    order = np.argsort(-np.bincount(code, minlength=len(told.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    parts = [one(ids), one(pa.array(lengths.astype(np.int32))), one(told.dictionary.take(pa.array(order))), pa.array([packed._planes(rank[code])], pa.binary())]
    batch = pa.RecordBatch.from_arrays(parts, ["doc", "lengths", "names", "words"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_COMPRESSED) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@dataclass
class Slice:
    """A slice's documents and terms: ``order`` is that of its terms by digest, and so by share, ``share`` each term's."""

    docs: pa.Array
    names: list[str]
    term: np.ndarray
    runs: np.ndarray
    at: np.ndarray
    n: np.ndarray
    digest: np.ndarray
    share: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, words: pa.Array, lengths: np.ndarray, stop: set[str], pairs: bool, shares: int) -> Slice:
        head = _starts(ids)
        owner = np.repeat(np.arange(len(head)), np.diff(head, append=len(ids)))
        rows, names, term, runs, at, n = packed.numbered(words, np.repeat(np.arange(len(lengths)), lengths), stop, pairs, owner)
        digest = packed.digests_of(names, term)
        share = ((digest[:, 0] >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)
        return cls(ids.take(pa.array(head[rows])), names, term, runs, at, n, digest, share, np.argsort(digest[:, 0], kind="stable"))

    @classmethod
    def read(cls, x: bytes, stop: set[str], pairs: bool, shares: int) -> Slice:
        batch = pa.ipc.open_stream(x).read_next_batch()
        code = packed._numbers(batch.column("words")[0].as_py()).astype(np.int32)
        told = pa.DictionaryArray.from_arrays(pa.array(code), batch.column("names").values)
        return cls.of(batch.column("doc").values, told, batch.column("lengths").values.to_numpy(), stop, pairs, shares)

    def answered(self, answers: list[bytes]) -> np.ndarray:
        """The numbers that the shares gave, for each term."""
        out = np.empty(len(self.term), np.int64)
        out[self.order] = np.concatenate([_unpacked(a) for a in answers])
        return out

    def terms(self, which: np.ndarray) -> pa.Array:
        """Terms as text."""
        names, term, many = pa.array(self.names, pa.string()), self.term[which], len(self.names)
        pair = np.maximum(term - many, 0)
        first = names.take(pa.array(np.where(term < many, term, pair // many)))
        second = names.take(pa.array(pair % many, mask=term < many))
        return pc.if_else(pc.is_valid(second), pc.binary_join_element_wise(first, second, " "), first)


def _packed(x: np.ndarray) -> bytes:
    return np.uint32(len(x)).tobytes() + pa.compress(packed._planes(x), codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b[:4], np.uint32)[0])
    return packed._numbers(pa.decompress(b[4:], n * 4, codec="zstd", asbytes=True)).astype(np.int64)


def shares_of(docs: DataFrame, n_docs: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // packed.SHARE_DOCS)


def said(docs: DataFrame, n_docs: int, stop: list[str], pairs: bool = True) -> DataFrame:
    """Slices and the answers to them, of ``docs`` (``doc``, ``words``, ``asked``).

    ``kind`` 1 has a slice's words, ``kind`` 0 one share's (``part``) answers: twice the number of documents of each of the
    slice's terms, and one more where a document that is ``asked`` about has it. Rows of one ``doc`` count as one document.
    Terms are told apart by 80 bits of their digests.
    """
    spark = docs.sparkSession
    ship(spark)
    shares, most, most_asked, stops = shares_of(docs, n_docs), SLICE, ASKED_SLICE, set(stop)
    # Only where a document has several rows must rows meet; else texts are worked on where they are read.
    if not docs.groupBy("doc").count().where("count > 1").isEmpty():
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    docs = docs.sortWithinPartitions("doc")  # a task that is run again makes the same slices

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for asked, ids, words in gathered(batches, most, most_asked):
            lengths = np.diff(words.offsets.to_numpy())
            flat = words.flatten()
            body = _written(ids, flat, lengths, stops)
            s = Slice.read(body, stops, pairs, shares)
            if not len(s.docs):
                continue
            digest, runs = s.digest[s.order], s.runs[s.order]
            found, first = np.unique(s.share[s.order], return_index=True)
            out = [(p, 0, asked, number, _planes(np.diff(digest[a:b, 0], prepend=np.uint64(0))), digest[a:b, 1].astype("<u2").tobytes(), packed._planes(runs[a:b])) for p, a, b in zip(found.tolist(), first.tolist(), np.append(first[1:], len(runs)).tolist(), strict=True)]
            out.append((((number >> 32) * 7919 + (number & 0xFFFFFFFF)) % shares, 1, asked, number, body, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["share", "kind", "asked", "slice", "x", "y", "z"])
            number += 1

    def answers(share: int, held: list[tuple]) -> list[tuple]:
        asked, slices, *_ = zip(*held, strict=True)
        h, l, runs = (np.concatenate([f(r[k]) for r in held]) for f, k in ((_steps, 2), (lambda b: np.frombuffer(b, "<u2"), 3), (packed._numbers, 4)))  # noqa: E741
        cut = np.cumsum([len(r[2]) // 8 for r in held])
        of = np.repeat(np.array(asked), np.diff(cut, prepend=0))
        order = np.argsort(h, kind="stable")
        if ((h[order][1:] == h[order][:-1]) & (l[order][1:] != l[order][:-1])).any():
            order = np.lexsort((l, h))
        hs, ls = h[order], l[order]
        first = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])))
        told = np.add.reduceat(runs[order].astype(np.int64), first) * 2 + np.logical_or.reduceat(of[order], first)
        each = np.empty(len(h), np.int64)
        each[order] = np.repeat(told, np.diff(first, append=len(h)))
        return [(a, s, 0, share, _packed(x)) for a, s, x in zip(asked, slices, np.split(each, cut[:-1]), strict=True)]

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["asked", "slice", "kind", "part", "x"])

        now, held = None, []
        for batch in batches:
            share, kind, asked, slices = (batch.column(c).to_pylist() for c in ("share", "kind", "asked", "slice"))
            x, y, z = (batch.column(c) for c in ("x", "y", "z"))
            for i in range(batch.num_rows):
                if held and (share[i] != now or kind[i]):
                    yield given(answers(now, held))
                    held = []
                now = share[i]
                if kind[i]:
                    yield given([(asked[i], slices[i], 1, 0, x[i].as_py())])
                else:
                    held.append((asked[i], slices[i], x[i].as_py(), y[i].as_py(), z[i].as_py()))
        if held:
            yield given(answers(now, held))

    rows = docs.select("doc", "words", "asked").mapInArrow(asking, "share int, kind int, asked boolean, slice long, x binary, y binary, z binary")
    return rows.repartitionById(shares, F.col("share")).sortWithinPartitions("share", "kind", "slice").mapInArrow(answering, _SAID)


def told(batches: Iterator[pa.RecordBatch], stop: set[str], pairs: bool, shares: int) -> Iterator[tuple[Slice, np.ndarray]]:
    """Each slice with the answers for its terms, of rows by slice, kind and part."""
    held: list[bytes] = []
    for batch in batches:
        kind, x = batch.column("kind").to_pylist(), batch.column("x")
        for i in range(batch.num_rows):
            if kind[i]:
                s = Slice.read(x[i].as_py(), stop, pairs, shares)
                yield s, s.answered(held)
                held = []
            else:
                held.append(x[i].as_py())


def dealt(parts: int) -> Column:
    """Slices over so many parts, about as many in each."""
    return F.pmod(F.shiftright("slice", 32) * 7919 + F.col("slice").bitwiseAND(0xFFFFFFFF), F.lit(parts)).cast("int")


def idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log((n_docs + 1) / (df + 1)) + 1


def weights(docs: DataFrame, n_docs: int, stop: list[str], pairs: bool = True, min_df: int = 1) -> DataFrame:
    """``doc``, ``term``, ``w``: normalised weights of the terms of ``docs`` (``doc``, ``words``) that ``min_df`` documents have."""
    kind, stops, shares = docs.schema["doc"].dataType.simpleString(), set(stop), shares_of(docs, n_docs)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, x in told(batches, stops, pairs, shares):
            df = x // 2
            which = np.flatnonzero(df >= min_df)
            some = np.repeat(df >= min_df, s.runs)
            at, runs = s.at[some], s.runs[which]
            w = (1 + np.log(s.n[some])) * np.repeat(idf(n_docs, df[which]), runs)
            w /= np.sqrt(np.bincount(at, w * w, len(s.docs)))[at]
            terms, of = s.terms(which), np.repeat(np.arange(len(which)), runs)
            for i in range(0, len(w), OUT):
                j = slice(i, i + OUT)
                yield pa.RecordBatch.from_arrays([s.docs.take(pa.array(at[j])), terms.take(pa.array(of[j])), pa.array(w[j])], ["doc", "term", "w"])

    met = said(docs.withColumn("asked", F.lit(False)), n_docs, stop, pairs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartitionById(parts, dealt(parts)).sortWithinPartitions("slice", "kind", "part").mapInArrow(given, f"doc {kind}, term string, w double")
