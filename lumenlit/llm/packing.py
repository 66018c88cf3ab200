"""Packing token sequences by cutting-stock column generation.

Each document is tokenised once, whole; runs of ``length`` tokens become pieces of their
own and the rest one piece more. Only the histogram of piece lengths (in classes of
``unit`` tokens, at most ``length / unit`` of them) goes to the driver, where column
generation turns it into patterns. Pieces are ranked within their class by counts of
groups of hashed content, so no class, however hot, is sorted in one task; rank r of a
class takes the r-th place that the patterns have for it. Order comes from ids and
content alone, so the sequences don't depend on files or partitions.

Defined results: null and empty texts are the end token alone; a text longer than a
sequence is cut every ``length`` tokens; equal documents and repeated rows are packed
each on its own; an empty table gives an empty one; other columns of the input, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.llm import words
from lumenlit.llm.common import persisted, tidy
from lumenlit.llm.cutting_stock import plan

LENGTH = 4096
UNIT = 8
END = 2
#: Words whose ids a Python worker remembers (about 25 bytes each).
REMEMBERED = 1_200_000
#: Texts taken out of an Arrow batch at once.
STEP = 1024
#: Closing marks that such a tokenizer parts from the letters before them.
MARKS = b".,!?;:|$%&*#"
#: Pieces in a ranked group, on average.
GROUP = 2_000
_tokenizers: dict[str, object] = {}


class Ragged:
    """Lists of ids by the sorted hashes of their words."""

    def __init__(self, keys: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        self.keys, self.length, self.flat = keys, length, flat
        self.start = np.cumsum(length) - length

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at the given places, one after another, and how many each has."""
        n = self.length[at]
        return self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.start[at], n)], n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def joined(self, other: Ragged) -> Ragged:
        """Both, whose keys differ, as one."""
        keys = np.concatenate((self.keys, other.keys))
        order = np.argsort(keys, kind="stable")
        length, flat = np.concatenate((self.length, other.length)), np.concatenate((self.flat, other.flat))
        flat, length = Ragged(keys, length, flat).take(order)
        return Ragged(keys[order], length, flat)


def _none() -> Ragged:
    return Ragged(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32))


class WordTokenizer:
    """Ids of whole texts for lower-casing tokenizers that never join what ASCII white space parts.

    Words are told apart by 64-bit hashes. Their ids are remembered in two generations:
    what is met again moves to the younger one, and when that is full the older one goes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.young, self.old = _none(), _none()

    def recalled(self, keys: np.ndarray) -> tuple[Ragged, np.ndarray]:
        """What is known of sorted keys, and which are unknown."""
        at, before = self.young.find(keys), self.old.find(keys)
        again = np.flatnonzero((at < 0) & (before >= 0))
        if len(again):
            flat, length = self.old.take(before[again])
            self.remember(Ragged(keys[again], length, flat))
            at = self.young.find(keys)
        known = np.flatnonzero(at >= 0)
        flat, length = self.young.take(at[known])
        return Ragged(keys[known], length, flat), np.flatnonzero(at < 0)

    def remember(self, new: Ragged) -> None:
        if len(self.young.keys) > REMEMBERED // 2:
            self.young, self.old = _none(), self.young
        self.young = self.young.joined(new)

    def learnt(self, some: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]

    def told(self, keys: np.ndarray, word: Callable[[int], bytes]) -> Ragged:
        """The ids of sorted keys; ``word`` gives the bytes of the i-th. A word with closing marks is looked up in two parts."""
        known, unknown = self.recalled(keys)
        if not len(unknown):
            return known
        new = [word(i) for i in unknown]
        split = {w: (core, w[len(core) :]) for w in new if len(core := w.rstrip(MARKS)) < len(w) and core and core.decode().isalpha()}
        parts = sorted({x for p in split.values() for x in p} | {w for w in new if w not in split})
        data, _ = words.buffer(parts)
        hashed = words.hashes(data, *words.spans(data))
        order = np.argsort(hashed)
        there, missing = self.recalled(hashed[order])
        lists = dict(zip(there.keys.tolist(), np.split(there.flat, np.cumsum(there.length)[:-1]) if len(there.keys) else [], strict=True))
        ids = self.learnt([parts[order[i]] for i in missing])
        lists |= dict(zip(hashed[order][missing].tolist(), ids, strict=True))
        name = dict(zip(parts, hashed.tolist(), strict=True))
        whole = [np.concatenate([lists[name[x]] for x in split[w]]) if w in split else lists[name[w]] for w in new]
        made = Ragged(keys[unknown], np.fromiter(map(len, whole), np.int64, len(whole)), np.concatenate(whole))
        self.remember(made)
        # Parts that aren't words of this text are remembered too.
        apart = [(h, x) for h, x in zip(hashed[order][missing].tolist(), ids, strict=True)]
        held = self.young.find(np.array([h for h, _ in apart], np.uint64)) if apart else np.empty(0)
        rest = [x for x, at in zip(apart, held, strict=True) if at < 0]
        if rest:
            self.remember(Ragged(np.array([h for h, _ in rest], np.uint64), np.array([len(x) for _, x in rest]), np.concatenate([x for _, x in rest])))
        return known.joined(made)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        for part in words.portions(texts):
            raw, first = words.buffer(texts[part])
            data = words.LOWER[raw]
            a, b = words.spans(data)
            bounds = np.searchsorted(a, first)
            keys, one, word = np.unique(words.hashes(data, a, b), return_index=True, return_inverse=True)
            flat, n = self.told(keys, lambda i, data=data, a=a[one], b=b[one]: data[a[i] : b[i]].tobytes()).take(word)
            cut = np.concatenate(([0], np.cumsum(n)))[bounds]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                yield flat[i:j].astype("<u4").tobytes()


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = tokenizer(path).encode
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                rows: list[tuple] = []
                for i, ids in zip(part.column(0).to_pylist(), encode([t or b"" for t in part.column(1).to_pylist()]), strict=True):
                    whole = ids + end
                    n = len(whole) // 4
                    rows += [(i, a, min(length, n - a), zlib.crc32(whole[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return docs.mapInArrow(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def ranked(df: DataFrame, key: str, group: int = GROUP) -> DataFrame:
    """Pieces with their ``rank`` long within each key, from 0 and without gaps, however many pieces a key has."""
    groups = max(1, df.count() // group)
    hashed = df.withColumn("_group", F.pmod(F.xxhash64(*PIECE), F.lit(groups)))
    counts = hashed.groupBy(key, "_group").count()
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(key, "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_group").orderBy(*PIECE)) - 1
    return hashed.withColumn("_within", within).join(first, [key, "_group"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_group", "_within", "_before")


def pack(cut: DataFrame, length: int = LENGTH, unit: int = UNIT, gap: float = 0.002) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence)."""
    capacity = length // unit
    stored = persisted(cut.withColumn("size", F.ceil(F.col("length") / unit).cast("int")))
    demand = np.zeros(capacity + 1, np.int64)
    for r in stored.groupBy("size").count().collect():  # a row for each class
        demand[r["size"]] = r["count"]
    runs, first, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, times in plan(demand, capacity, gap):
        for size, each in pattern.items():
            runs.append((size, int(taken[size]), int(taken[size]) + each * times, each, first))
            taken[size] += each * times
        first += times
    table = cut.sparkSession.createDataFrame(runs, "size int, _from long, _to long, _each long, _first long")
    # Runs: one for each size in a pattern, so bounded by the classes and not by the documents.
    placed = ranked(stored, "size").join(F.broadcast(table), "size").where("rank >= _from and rank < _to")
    placed = placed.withColumn("sequence_id", F.expr("_first + (rank - _from) div _each"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("size", "rank", "_from", "_to", "_each", "_first")


def manifest(packed: DataFrame) -> DataFrame:
    """A row for each sequence: its pieces in order and its ``used`` tokens (at most ``LENGTH`` pieces)."""
    piece = F.struct("offset", "doc_id", "start", "length")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(piece)).alias("pieces"))
