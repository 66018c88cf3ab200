"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ten words; every rolling
ten-word window of every document probes them. A repeat of twenty words holds a whole
reference block of its earlier place, so each repeat has a hit at both places. Around
each hit the twenty-word windows are compared over all documents by a 64-bit hash, runs
of repeated windows being the maximal repeats, and every word of a window that also
starts earlier is removed.

Documents are put in order once (by id, then by the hash of the text) and packed into
portions of text, numbered in that order. So a window is late if a portion of smaller
number has it, or an earlier place of its own portion, and what travels is hashes alone,
a portion's distinct ones, sorted and packed (about three bytes a word for blocks, six
for the windows around hits): a passage that many documents share costs an entry for
each portion and not one for each pair. Blocks are matched by 28 bits in addition to
those of their group, which finds every hit and few others; windows by all 64 bits.

A group of hashes is what one task holds; rows stay packed while a portion has some
hundred hashes in each group. At the defaults that is so up to about a terabyte of text;
beyond it raise ``portion`` and ``group`` together, as far as a task's memory goes.

Windows are judged on the input. Defined results: null and empty texts have no words;
documents shorter than a window keep everything; rows with equal id and text are one
document and all get its result; rows with equal id and different text are ordered by a
hash of the text; null ids come last; an empty table gives an empty one; a text longer
than a portion is a portion of its own; other columns of the input, whatever their names,
are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm import words
from lumenlit.llm.common import stored, tidy

WINDOW = 20
BLOCK = 10
#: Entries in a group, on average, and bytes of text in a portion.
GROUP = 2_000_000
PORTION = 6 << 20
#: Bits of a block's hash that are compared in addition to its group's.
BLOCK_BITS = 28
LAST = (1 << 63) - 1
_B = np.uint64(0xD6E8FEB86659FD93)


def rolled(key: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` keys."""
    span, power, level, done, out = 1, np.array([_B]), words.mix(key, 3), 0, None
    while span <= width:
        if width & span:  # add the next ``span`` keys, from where the last part ended
            part = level[done:]
            n = len(key) - done - span + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            out = part[:n].copy() if out is None else out[:n] * power + part[:n]
            done += span
        if 2 * span > width or len(level) <= span:
            break
        level = level[:-span] * power + level[span:]
        power = power * power
        span *= 2
    return words.mix(out, 5) if out is not None and done == width else np.empty(0, np.uint64)


def _cuts(sorted_key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(sorted_key) else np.empty(0, np.int64)


def packed(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers of ``width`` bits: how many share each high part, then the low parts in whole bytes."""
    n = len(values)
    high = width % 8
    while high + 8 <= 16 and 1 << (high + 8) <= 2 * n:
        high += 8
    low = width - high
    counts = np.bincount((values >> np.uint64(low)).astype(np.int64), minlength=1 << high)
    size = 1 if counts.max(initial=0) < 256 else 4
    head = np.array([n, high, size], "<u4").tobytes()
    parts = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, : low // 8]
    return head + counts.astype(f"<u{size}").tobytes() + parts.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    n, high, size = np.frombuffer(data, "<u4", 3).tolist()
    low = width - high
    counts = np.frombuffer(data, f"<u{size}", 1 << high, 12)
    parts = np.zeros((n, 8), np.uint8)
    parts[:, : low // 8] = np.frombuffer(data, np.uint8, offset=12 + size * (1 << high)).reshape(n, low // 8)
    return parts.view("<u8").ravel() | np.repeat(np.arange(1 << high, dtype=np.uint64) << np.uint64(low), counts)


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(3)
        small = pa.array((pack.compress(texts[i].as_buffer()) for i in range(len(texts))), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], small], ["id", "known", "print", "packed"])


PORTIONS = "portion long, ids binary, known binary, times binary, sizes binary, packed binary"


def _portions(size: int):
    """Rows of documents in order to rows of portions; equal rows become one document with its ``times``."""
    schema = pa.schema([("portion", pa.int64()), *((c, pa.binary()) for c in ("ids", "known", "times", "sizes", "packed"))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        serial, own, texts, held, last = 0, [], [], 0, None

        def row() -> pa.RecordBatch:
            ids, known, times = (np.array(c, k) for c, k in zip(zip(*own, strict=True), ("<i8", "u1", "<i8"), strict=True))
            sizes = np.array([len(t) for t in texts], "<i8")
            whole = pack.compress(b"".join(x for t in texts for x in (t, b"\n")))
            number = TaskContext.get().partitionId() << 32 | serial
            return _table([[number], *([x.tobytes()] for x in (ids, known, times, sizes)), [whole]], schema)

        for batch in batches:
            for i, known, key, small in zip(*(batch.column(c).to_pylist() for c in ("id", "known", "print", "packed")), strict=True):
                if last == (i, key, known):
                    own[-1][2] += 1
                    continue
                text = unpack.decompress(small)
                if own and held + len(text) > size:
                    yield row()
                    serial, own, texts, held = serial + 1, [], [], 0
                own.append([i, known, 1])
                texts.append(text)
                held, last = held + len(text), (i, key, known)
        if own:
            yield row()

    return make


class Portion:
    """The words of a portion's texts."""

    def __init__(self, row: dict) -> None:
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        a, b = words.spans(self.data)
        self.bounds = np.searchsorted(a, self.first)
        self.key = words.hashes(self.data, a, b)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the run from each word on, and which words begin a run within their text."""
        h = rolled(self.key, width)
        whole = np.ones(len(h), bool)
        for b in self.bounds[1:-1]:
            whole[max(0, b - width + 1) : b] = False
        return h, np.flatnonzero(whole)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of blocks, which are a reference block here, how often each occurs, and the hash at each place."""
        h, at = self.windows(BLOCK)
        anchor = (at - self.bounds[np.searchsorted(self.bounds, at, "right") - 1]) % BLOCK == 0
        order = np.argsort(h[at], kind="stable")
        ranked = h[at][order]
        first = _cuts(ranked)
        if not len(first):
            return ranked, np.empty(0, bool), np.empty(0, np.int64), h
        return ranked[first], np.maximum.reduceat(anchor[order], first), np.diff(np.append(first, len(ranked))), h


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


ENTRIES = "group int, portion long, hashes binary, anchors binary"
_ENTRIES = pa.schema([("group", pa.int32()), ("portion", pa.int64()), ("hashes", pa.binary()), ("anchors", pa.binary())])
FOUND = "portion long, group int, hashes binary"
_FOUND = pa.schema([("portion", pa.int64()), ("group", pa.int32()), ("hashes", pa.binary())])


def _split(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of sorted hashes (by the first bits), and where each begins (and the last ends)."""
    group = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    first = _cuts(group)
    return group[first], np.append(first, len(group))


def _low(hashes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The ``width`` bits after the first ``bits``."""
    return hashes >> np.uint64(64 - bits - width) & np.uint64((1 << width) - 1)


def _first_bits(table: pa.Table, width: int) -> np.ndarray:
    """The first bits (a group's and ``width`` more) of all hashes found in a portion, in order."""
    found = [unpacked(x, width) | np.uint64(g << width) for g, x in zip(table.column("group").to_pylist(), table.column("hashes").to_pylist(), strict=True)]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _told(group: int, portion: np.ndarray, value: np.ndarray, width: int) -> pa.Table:
    """A row for each portion with its values, both sorted."""
    cut = np.append(_cuts(portion), len(portion))
    rows = [(int(portion[i]), group, packed(value[i:j], width)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_batches([_table([list(c) for c in zip(*rows, strict=True)] or [[], [], []], _FOUND)])


def block_hits(table: DataFrame, bits: int) -> DataFrame:
    """``portion``, ``group``, ``hashes`` of blocks that another portion has too and that are a reference block in one of them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, anchor, _, _ = Portion(row).anchors()
            groups, cut = _split(hashes, bits)
            # Hashes that agree in all bits that are kept are one entry, an anchor if one of them is.
            for g, i, j in zip(groups.tolist(), cut[:-1], cut[1:], strict=True):
                low = _low(hashes[i:j], bits, BLOCK_BITS)
                first = _cuts(low)
                marks = np.packbits(np.maximum.reduceat(anchor[i:j], first)).tobytes()
                yield _table([[g], [row["portion"]], [packed(low[first], BLOCK_BITS)], [marks]], _ENTRIES)

    def meet(table: pa.Table) -> pa.Table:
        values, rows = [], table.column("portion").to_pylist()
        for k, (data, marks) in enumerate(zip(table.column("hashes").to_pylist(), table.column("anchors").to_pylist(), strict=True)):
            low = unpacked(data, BLOCK_BITS)
            anchor = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(low)).astype(np.uint64)
            values.append(low << np.uint64(64 - BLOCK_BITS) | np.uint64(k << 1) | anchor)
        both = np.sort(np.concatenate(values))
        low = both >> np.uint64(64 - BLOCK_BITS)
        first = _cuts(low)
        times = np.diff(np.append(first, len(low)))
        anchor = np.maximum.reduceat(both & np.uint64(1), first) > 0
        hit = both[np.repeat(anchor & (times > 1), times)]
        portion = np.array(rows)[(hit >> np.uint64(1) & np.uint64((1 << (63 - BLOCK_BITS)) - 1)).astype(np.int64)]
        order = np.argsort(portion, kind="stable")
        return _told(table.column("group")[0].as_py(), portion[order], hit[order] >> np.uint64(64 - BLOCK_BITS), BLOCK_BITS)

    return table.mapInArrow(tidy(blocks), ENTRIES).groupBy("group").applyInArrow(meet, FOUND)


def late_windows(table: DataFrame, hits: DataFrame, block_bits: int, bits: int) -> DataFrame:
    """``portion``, ``group``, ``hashes`` of windows around hits that a portion before it has too."""

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            p = Portion(row)
            hashes, anchor, times, block = p.anchors()
            own = hashes[anchor & (times > 1)]
            shared = _first_bits(right, BLOCK_BITS)
            mark = _is_in(block, own) | _is_in(block >> np.uint64(64 - block_bits - BLOCK_BITS), shared)
            before = np.concatenate(([0], np.cumsum(mark)))
            h, at = p.windows(WINDOW)
            reach = WINDOW - BLOCK + 1
            # Places whose block runs over the end of a text may be marked; that only adds windows.
            near = np.unique(h[at[before[at + reach] > before[at]]])
            groups, cut = _split(near, bits)
            rows += [(g, row["portion"], packed(_low(near[i:j], bits, 64 - bits), 64 - bits), None) for g, i, j in zip(groups.tolist(), cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_batches([_table([list(c) for c in zip(*rows, strict=True)] or [[], [], [], []], _ENTRIES)])

    def meet(table: pa.Table) -> pa.Table:
        number = np.array(table.column("portion").to_pylist())
        data = table.column("hashes").to_pylist()
        order = np.argsort(number, kind="stable")
        values = [unpacked(data[i], 64 - bits) for i in order]
        portion = np.repeat(number[order], [len(v) for v in values])
        value = np.concatenate(values)
        by = np.argsort(value, kind="stable")
        late = np.ones(len(by), bool)
        late[_cuts(value[by])] = False
        late = np.sort(by[late])  # portions in order again, and each one's values as they came
        return _told(table.column("group")[0].as_py(), portion[late], value[late], 64 - bits)

    near = table.groupBy("portion").cogroup(hits.groupBy("portion")).applyInArrow(windows, ENTRIES)
    return near.groupBy("group").applyInArrow(meet, FOUND)


def finished(table: DataFrame, late: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            p = Portion(row)
            h, at = p.windows(WINDOW)
            again = np.ones(len(at), bool)
            order = np.argsort(h[at], kind="stable")
            again[order[_cuts(h[at][order])]] = False
            values = [unpacked(x, 64 - int(b)) | np.uint64(g << (64 - int(b))) for g, b, x in zip(*(right.column(c).to_pylist() for c in ("group", "bits", "hashes")), strict=True)]
            before = np.sort(np.concatenate(values)) if values else np.empty(0, np.uint64)
            start = at[again | _is_in(h[at], before)]
            edge = np.bincount(start, minlength=len(p.key) + WINDOW + 1) - np.bincount(start + WINDOW, minlength=len(p.key) + WINDOW + 1)
            keep = np.cumsum(edge)[: len(p.key)] == 0
            ids, known, times = (np.frombuffer(row[c], k).tolist() for c, k in (("ids", "<i8"), ("known", "u1"), ("times", "<i8")))
            raw = p.data.tobytes()
            for d in range(len(ids)):
                w = raw[p.first[d] : p.first[d] + p.sizes[d]].split()
                mine = keep[p.bounds[d] : p.bounds[d + 1]]
                n = int(mine.sum())
                kept = w if n == len(w) else compress(w, mine.tolist())
                rows += [(ids[d] if known[d] else None, len(w), len(w) - n, hashlib.sha256(b" ".join(kept)).hexdigest())] * times[d]
        return pa.Table.from_batches([_table([list(c) for c in zip(*rows, strict=True)] or [[], [], [], []], schema)])

    return table.groupBy("portion").cogroup(late.groupBy("portion")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", portion: int = PORTION, group: int = GROUP) -> DataFrame:
    """``doc_id`` (as a long), ``n_words``, ``n_removed`` and ``kept_sha256`` for each row of ``df``."""
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.col(doc_id).cast("long").isNotNull().alias("known"), F.xxhash64(text).alias("print"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = (int(size) // 6 // group).bit_length()
    small = docs.mapInArrow(tidy(_compressed), "id long, known boolean, print long, packed binary")
    ordered = small.repartitionByRange("id", "print").sortWithinPartitions("id", "print", "known")
    table = stored(ordered.mapInArrow(tidy(_portions(portion)), PORTIONS))
    window_bits = max(0, bits - 1)
    late = late_windows(table, block_hits(table, bits), bits, window_bits).withColumn("bits", F.lit(window_bits))
    return finished(table, late)
