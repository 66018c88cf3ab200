"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without shuffling a pre-token.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each on its own, so a
text's count is the sum of its pre-tokens' lengths in tokens. Pre-tokens are found in the
bytes of many texts at once, with one look-up for all of them:

1. the first tier is a broadcast hash table of the frequent pre-tokens' lengths. Each task
   sums up its rows in a Misra-Gries summary of at most ``FREQUENT`` pre-tokens, and
   summaries are merged by ``MERGED``; whatever makes up more than 1 in ``FREQUENT`` of all
   pre-tokens of the table is in the result, and nothing larger than that is sent.
2. what the table lacks is looked up in the Python worker's cache, which lives on from
   task to task, and is encoded once where that lacks it too.

The tiers decide the speed only; with empty ones the counts are the same.

Pre-tokens are told apart by 64-bit hashes up to ``LONGEST`` bytes and encoded each time
beyond, so that two of a million million clash with a chance of some millionths. Characters that
Python's Unicode tables don't know (the library's may be newer) send their text to the
library's own pre-tokenizer.

Defined results: null and empty texts have no bytes and no tokens; special strings are one
token each, as the library's default has it; repeated rows are counted each on its own; an
empty table gives an empty one; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm import words
from lumenlit.llm.common import tidy

#: Pre-tokens in the broadcast table, at most; each takes some 20 bytes there.
FREQUENT = 16_384
#: Pre-tokens that a Python worker remembers, in two generations.
REMEMBERED = 1_000_000
#: Bytes of the longest pre-token that is told by its hash.
LONGEST = 64
#: Bytes of text that are worked on together, and of a text after which it is cut.
STEP = 2 << 20
#: Summaries that are merged at once.
MERGED = 16
SPACE, LETTER, NUMBER, OTHER, END, UNKNOWN = range(6)
#: A byte that UTF-8 never has parts the texts.
BREAK = 0xFF


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    known = {"L": LETTER, "N": NUMBER}
    told = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
    table = np.fromiter((UNKNOWN if k == "Cn" else known.get(k[0], OTHER) for k in told), np.uint8, sys.maxunicode + 1)
    # White space as Unicode has it.
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def classed(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = classes()
    small = np.full(256, OTHER, np.uint8)
    small[:128], small[BREAK] = table[:128], END
    out = small[data]
    lead = np.flatnonzero((data >= 0xC0) & (data != BREAK))
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = lead[size == n]
            code = data[at].astype(np.uint32) & mask
            for i in range(1, n):
                code = code << 6 | (data[at + i] & 0x3F)
            kind = table[code]
            for i in range(n):
                out[at + i] = kind
    return out


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of texts that begin and end with a ``BREAK``.

    Runs of letters, of numbers and of other characters, each with one blank before it;
    runs of white space, whose last character is apart where a word follows; and the
    endings of English contractions.
    """
    begin = np.zeros(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:-1])
    begin[0] = begin[-1] = True
    begin[:-1] |= kind == END
    word = (kind >= LETTER) & (kind <= OTHER)
    follows = np.flatnonzero(word[1:] & (kind[:-1] == SPACE)) + 1
    last = follows - 1
    for _ in range(2):  # white space has three bytes at most
        last = last - ((data[last] & 0xC0) == 0x80)
    begin[follows] = data[follows - 1] != 0x20
    begin[last] = True
    quote = np.flatnonzero(data[:-3] == 0x27)
    quote = quote[(kind[quote - 1] != OTHER) & (data[quote - 1] != 0x20)]
    a, b = data[quote + 1], data[quote + 2]
    # Fixed values: 's 't 'm 'd and 're 've 'll.
    short = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    begin[quote[short | long] + 1] = False
    begin[quote[short] + 2] = True
    begin[quote[long] + 3] = True
    at = np.flatnonzero(begin)
    start, end = at[:-1], at[1:]
    some = kind[start] != END
    return start[some], end[some]


class Table:
    """Lengths by hash, open addressing in two flat arrays."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys, self.lengths, self.probes = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.uint32), 0
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.lengths[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            placed = left[free][first]
            self.keys[taken], self.lengths[taken] = keys[placed], lengths[placed]
            rest = ~np.isin(left, placed)
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.mask
            self.probes += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The length of each key, 0 where there is none."""
        slot = keys & self.mask
        out = np.where(self.keys[slot] == keys, self.lengths[slot], 0)
        open_ = np.flatnonzero((out == 0) & (self.lengths[slot] != 0))
        for i in range(1, self.probes):
            if not len(open_):
                break
            slot = (keys[open_] + np.uint64(i)) & self.mask
            out[open_] = np.where(self.keys[slot] == keys[open_], self.lengths[slot], 0)
            open_ = open_[(out[open_] == 0) & (self.lengths[slot] != 0)]
        return out


class Counter:
    """Token counts of texts, with what this process has met before."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            told = json.load(f)
        pre = told["pre_tokenizer"]
        if told.get("normalizer") or told["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("special strings must stand for themselves")
        special = sorted((t["content"].encode() for t in told["added_tokens"]), key=lambda t: (-len(t), t))
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        nothing = Table(np.empty(0, np.uint64), np.empty(0, np.uint32))
        self.young, self.old, self.fresh = nothing, nothing, {}

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return np.fromiter(map(len, encoded), np.uint32, len(texts))

    def remember(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        self.fresh.update(zip(keys.tolist(), lengths.tolist(), strict=True))
        held = len(self.young.keys) // 4
        if len(self.fresh) > max(4096, held):  # tables are made anew as they double
            new = Table(np.array(list(self.fresh), np.uint64), np.array(list(self.fresh.values()), np.uint32))
            there = self.young.lengths > 0
            apart = there & (new.find(self.young.keys) == 0)
            both = np.concatenate((self.young.keys[apart], new.keys[new.lengths > 0])), np.concatenate((self.young.lengths[apart], new.lengths[new.lengths > 0]))
            self.young, self.fresh = Table(*both), {}
            if len(both[0]) > REMEMBERED // 2:
                self.young, self.old = Table(np.empty(0, np.uint64), np.empty(0, np.uint32)), self.young

    def of_misses(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """The lengths of pre-tokens that the broadcast table lacks."""
        keys, one, back = np.unique(hashed, return_index=True, return_inverse=True)
        out = self.young.find(keys)
        for i in np.flatnonzero(out == 0) if self.fresh else ():
            out[i] = self.fresh.get(int(keys[i]), 0)
        absent = np.flatnonzero(out == 0)
        if len(absent):
            out[absent] = self.old.find(keys[absent])
            new = absent[out[absent] == 0]
            if len(new):
                out[new] = self.lengths([data[a:b].tobytes() for a, b in zip(start[one[new]], end[one[new]], strict=True)])
            self.remember(keys[absent], out[absent])
        return out[back]

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A text between its special strings, each cut before blanks where a new pre-token begins whatever follows."""
        for part in self.special.split(text) if self.special else [text]:
            at = 0
            while len(part) - at > STEP:
                cut = at + STEP
                while (cut := part.find(b" ", cut)) > 0 and (part[cut - 1] >= 0x80 or words.SPACE[part[cut - 1]]):
                    cut += 1
                if cut < 0:
                    break
                yield part[at:cut]
                at = cut
            yield part[at:]

    def specials(self, text: bytes) -> int:
        return sum(1 for _ in self.special.finditer(text)) if self.special else 0

    def portions(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, start and end of pre-tokens and the place of their text, for about ``STEP`` bytes at once."""
        flat = [(i, part) for i, t in enumerate(texts) for part in self.parts(t)]
        for some in words.portions([p for _, p in flat], STEP):
            mark = bytes([BREAK])
            of, held = zip(*flat[some], strict=True)
            data = np.frombuffer(mark + mark.join(held) + mark * 3, np.uint8)
            kind = classed(data)
            first = np.cumsum([1] + [len(p) + 1 for p in held])
            if (kind == UNKNOWN).any():
                odd = np.unique(np.searchsorted(first, np.flatnonzero(kind == UNKNOWN), "right") - 1)
                start, end = spans(data, kind)
                place = np.searchsorted(first, start, "right") - 1
                keep = ~np.isin(place, odd)
                own = [(first[j] + a, first[j] + b, j) for j in odd for a, b in self.cut_by_library(held[j])]
                start, end, place = (np.concatenate((x[keep], np.array(y, np.int64))) for x, y in zip((start, end, place), zip(*own, strict=True), strict=True))
                order = np.argsort(start)
                start, end, place = start[order], end[order], place[order]
            else:
                start, end = spans(data, kind)
                place = np.searchsorted(first, start, "right") - 1
            yield data, start, end, np.array(of)[place]

    def cut_by_library(self, part: bytes) -> Iterator[tuple[int, int]]:
        text = part.decode()
        size = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            yield int(size[a]), int(size[b])

    def counts(self, texts: list[bytes], table: Table) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.fromiter(map(self.specials, texts), np.int64, len(texts))
        for data, start, end, of in self.portions(texts):
            length = np.zeros(len(start), np.uint32)
            told = end - start <= LONGEST
            hashed = words.hashes(data, start[told], end[told])
            short = table.find(hashed)
            miss = np.flatnonzero(short == 0)
            if len(miss):
                place = np.flatnonzero(told)[miss]
                short[miss] = self.of_misses(data, start[place], end[place], hashed[miss])
            length[told] = short
            if not told.all():
                length[~told] = self.lengths([data[a:b].tobytes() for a, b in zip(start[~told], end[~told], strict=True)])
            out += np.bincount(of, length, len(texts)).astype(np.int64)
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class Summary:
    """Misra-Gries: of all pre-tokens met, those above one in ``most`` are left; counts are lower bounds."""

    def __init__(self, most: int) -> None:
        self.most, self.counts = most, {}

    def add(self, pieces: list[bytes], counts: list[int]) -> None:
        held = self.counts
        for piece, n in zip(pieces, counts, strict=True):
            held[piece] = held.get(piece, 0) + n
        if len(held) > self.most:
            least = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -self.most - 1)[-self.most - 1])
            self.counts = {k: n - least for k, n in held.items() if n > least}

    def batch(self, group: int) -> pa.RecordBatch:
        columns = [pa.array([group], pa.int64()), pa.array([list(self.counts)], pa.list_(pa.binary())), pa.array([list(self.counts.values())], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "pieces", "counts"])


def frequent(df: DataFrame, path: str, text: str = "text", most: int = FREQUENT) -> list[bytes]:
    """The pre-tokens that make up more than 1 in ``most`` of all of the table's, and others, ``most`` in all at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = counter(path), Summary(most)
        for batch in batches:
            for part in words.portions(texts := [t or b"" for t in batch.column(0).to_pylist()], STEP):
                for data, start, end, _ in own.portions(texts[part]):
                    short = end - start <= LONGEST
                    a, b = start[short], end[short]
                    _, one, n = np.unique(words.hashes(data, a, b), return_index=True, return_counts=True)
                    if len(n) > most:  # the portion's own summary
                        least = np.partition(n, -most - 1)[-most - 1]
                        one, n = one[n > least], n[n > least] - least
                    total.add([data[x:y].tobytes() for x, y in zip(a[one], b[one], strict=True)], n.tolist())
        yield total.batch(TaskContext.get().partitionId())

    def merged(group: pa.Table) -> pa.Table:
        total = Summary(most)
        for pieces, counts in zip(group.column("pieces").to_pylist(), group.column("counts").to_pylist(), strict=True):
            total.add(pieces, counts)
        return pa.Table.from_batches([total.batch(group.column("part")[0].as_py() // MERGED)])

    schema = "part long, pieces array<binary>, counts array<long>"
    texts = df.select(F.col(text).cast("binary").alias("text"))
    n, out = texts.rdd.getNumPartitions(), texts.mapInArrow(tidy(summed), schema)
    while n > MERGED:
        out, n = out.groupBy(F.floor(F.col("part") / MERGED).alias("_group")).applyInArrow(merged, schema), -(-n // MERGED)
    total = Summary(most)
    for batch in out.toArrow().to_batches():  # MERGED summaries at most
        for pieces, counts in zip(batch.column("pieces"), batch.column("counts"), strict=True):
            total.add(pieces.as_py(), counts.as_py())
    return sorted(total.counts)


def lookup(spark, pieces: list[bytes], path: str) -> Broadcast:
    """The first tier, made on the driver of at most ``FREQUENT`` pre-tokens and broadcast."""
    if not pieces:
        return spark.sparkContext.broadcast(Table(np.empty(0, np.uint64), np.empty(0, np.uint32)))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(p) for p in pieces])
    keys = words.hashes(data, end - [len(p) for p in pieces], end)
    return spark.sparkContext.broadcast(Table(keys, Counter(path).lengths(pieces)))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = FREQUENT) -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of each row."""
    table = lookup(df.sparkSession, frequent(df, path, text, most), path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            sizes = pa.array(map(len, texts), pa.int64())
            parts = [own.counts(texts[part], table.value) for part in words.portions(texts, STEP)]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate(parts) if parts else [], pa.int64())], [key, "n_bytes", "n_tokens"])

    docs = df.select(F.col(key), F.col(text).cast("binary").alias("_text"))
    return docs.mapInArrow(tidy(counted), f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
