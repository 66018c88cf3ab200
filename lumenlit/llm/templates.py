"""Line dedup by a log-template tree.

A line falls through a tree of fixed depth: by its number of tokens, then by its leading
tokens; tokens with a digit are variable fields and all equal before. Within a leaf,
lines that agree in at least ``SIMILARITY`` of their places share a template, in which the
varying places are fields as well. A template that recurs in at least ``min_docs``
documents is dropped everywhere but in its first document (smallest id).

Documents with the same text count once (by the hash of the whole text), so a group of
exact copies alone makes no template; it is left to document dedup.

Lines are told apart by 64-bit hashes, made in Arrow batches without a Python object for
each word; counting, joining and dropping is done on those numbers. Leaves are never
collected. Lines of a leaf that differ in d places agree in one of d + 1 pieces of the
tokens after the leading ones, so each distinct line of a leaf that may recur is keyed by
its pieces. First the lines of a key are compared with its least line, which brings most
of a template together; then, in each key whose lines are still of several groups, every
line with every line of another group. So templates are the connected components of all
pairs that agree, whichever other lines share a key. A key of more than ``CELL`` lines for
each of d + 1 pieces is split first: what its lines don't have in common yet may still
differ in d places, so it is cut into d + 1 pieces again, one of which any two lines that agree share; and so on. Where
no more than d places are left, all lines agree, and are linked to the least of them
without comparing any. So a key's cost grows with its lines, not with its pairs. Only
where pieces would multiply beyond ``SPREAD`` (lines of very many tokens) are keys of more than
``CHUNK`` lines cut into a grid of cells. Counting happens before any join, so a line
that millions of documents share is one row from each task.

Defined results: null texts stay null and empty ones empty, without lines; blank lines
stay; rows with equal id and text are one document and all get its result; null ids come
last; an empty table gives an empty one; a text of any length is read whole. Other columns
stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.text import let
from lumenlit.llm import words
from lumenlit.llm.common import stored, tidy, unused
from lumenlit.operators.graph import components

SIMILARITY = 0.8
DEPTH = 3
MIN_DOCS = 5
#: Slots of the filter that tells tasks which leaves may recur (one byte each).
SLOTS = 1 << 20
#: Lines of a key, for each of the pieces it would be split into, up to which comparing all costs less
#: than splitting; and pieces that a line may come to in that way.
CELL = 2048
SPREAD = 64
#: Lines of a key which are compared in one piece, and tokens compared in one step.
CHUNK = 4096
STEP = 1 << 21
LAST = (1 << 63) - 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD = np.uint64(0x5F3C2A2E3E5D7A11)


class Lines:
    """The lines with words of some texts: where they are and their hashes."""

    def __init__(self, texts: list[bytes | None]) -> None:
        data, first = words.buffer(texts)
        ends = np.flatnonzero(data == 10)
        a, b = words.spans(data)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        self.token = np.where(digits[b] > digits[a], _FIELD, words.hashes(data, a, b))
        line = np.searchsorted(ends, a)
        self.begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
        self.n = np.diff(np.append(self.begin, len(line)))
        number = line[self.begin]
        self.text = np.searchsorted(first, np.concatenate(([0], ends[:-1] + 1))[number], "right") - 1 if len(number) else number
        self.place = number - np.searchsorted(ends, first[self.text])
        at = (np.arange(len(line)) - np.repeat(self.begin, self.n)).astype(np.uint64)
        mixed = words.mix(self.token + at * np.uint64(0x9E3779B97F4A7C15), 9)
        count = self.n.astype(np.uint64)
        self.h = words.mix(np.add.reduceat(mixed, self.begin) + count, 11) if len(self.begin) else np.empty(0, np.uint64)
        leaf = words.mix(count, 13)
        for i in range(DEPTH):
            has = self.n > i
            leaf[has] = words.mix(leaf[has] ^ mixed[self.begin[has] + i], 17)
        self.leaf = leaf


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes | None], pa.RecordBatch]]:
    """Some texts at a time, so that a batch is never there twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            some = batch.slice(i, 1024)
            yield some.column("text").to_pylist(), some


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, some in _texts(batches):
        for part in words.portions(texts, 1 << 20):
            own = Lines(texts[part])
            ids, prints = some.column("id").to_numpy()[part], some.column("print").to_numpy()[part]
            yield pa.RecordBatch.from_arrays([_long(x) for x in (ids[own.text], prints[own.text], own.place, own.h, own.leaf)], ["id", "print", "place", "h", "leaf"])


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("print"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every line with words: ``id``, ``print`` (hash of the text), ``place``, ``h``, ``leaf`` (hash of length and leading tokens)."""
    return _keyed(df, doc_id, text).mapInArrow(tidy(_find), "id long, print long, place long, h long, leaf long")


def line_tokens(df: DataFrame, crowded: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``leaf``, ``h``, ``t`` (hashes of tokens) of the distinct lines in crowded leaves.

    A filter of ``SLOTS`` bytes keeps most other lines from the shuffle; the join decides.
    """
    slots = np.zeros(SLOTS, bool)
    slots[[r[0] for r in crowded.select(F.pmod("leaf", F.lit(SLOTS))).distinct().collect()]] = True  # SLOTS rows at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _texts(batches):
            for part in words.portions(texts, 1 << 20):
                own = Lines(texts[part])
                at = np.flatnonzero(slots[own.leaf.view(np.int64) % SLOTS])
                at = at[np.unique(own.h[at], return_index=True)[1]]
                token = own.token.view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(own.n[at]))).astype(np.int32)
                flat = token[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - own.begin[at], own.n[at])]
                yield pa.RecordBatch.from_arrays([_long(own.leaf[at]), _long(own.h[at]), pa.ListArray.from_arrays(offsets, flat)], ["leaf", "h", "t"])

    found = _keyed(df, doc_id, text).select("text").mapInArrow(tidy(find), "leaf long, h long, t array<long>")
    return found.join(crowded, "leaf", "left_semi").groupBy("leaf", "h").agg(F.first("t").alias("t"))


def _tokens(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, and where those of each line begin and how many they are."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


def _allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many places lines of ``n`` tokens may differ."""
    return n - np.ceil(n * similarity - 1e-9).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], similarity: float, numbered: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            token, start, n = _tokens(part.column("t"))
            pieces = _allowed(n, similarity) + 1
            row = np.repeat(np.arange(len(n)), pieces)
            at = _places(np.zeros(len(n), np.int64), pieces)
            lead = np.minimum(n, DEPTH)[row]
            rest = n[row] - lead
            # The place within the line goes into the sum, which is one for each run of tokens.
            place = _places(np.zeros(len(n), np.int64), n).astype(np.uint64)
            flat = token[_places(start, n)].view(np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(flat + place * np.uint64(0x9E3779B97F4A7C15), 29), dtype=np.uint64)))
            first = (np.cumsum(n) - n)[row] + lead
            value = sums[first + (at + 1) * rest // pieces[row]] - sums[first + at * rest // pieces[row]]
            leaf = part.column("leaf").to_numpy().view(np.uint64)[row]
            key = words.mix(value + words.mix(leaf + at.astype(np.uint64), 31), 37)
            columns = [_long(key), _long(part.column("h").to_numpy()[row])]
            if numbered:
                columns.append(pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32), pa.array(at.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["key", "h", "path"][: len(columns)])


def _open_places(size: int, pieces: int, path: list[int]) -> np.ndarray:
    """The places of a line that a key says nothing of: all but the leading ones and the pieces of its path."""
    rest = np.arange(min(size, DEPTH), size)
    for at in path:
        rest = np.delete(rest, slice(at * len(rest) // pieces, (at + 1) * len(rest) // pieces))
    return rest


_SPLIT = ["key", "h", "root", "path", "may", "whole", "more"]


def _split(batches: Iterator[pa.RecordBatch], similarity: float, spread: int) -> Iterator[pa.RecordBatch]:
    """Keys of the pieces of what is open; ``whole`` if no more is open then than may differ, ``more`` if they may be split again."""
    for batch in batches:
        token, start, n = _tokens(batch.column("t"))
        key, h, root = (batch.column(c).to_numpy() for c in ("key", "h", "root"))
        paths = batch.column("path").to_pylist()
        alike: dict[tuple, list[int]] = {}
        for i, path in enumerate(paths):
            alike.setdefault((int(n[i]), *path), []).append(i)
        for (size, *path), rows in alike.items():
            row, may = np.array(rows), int(_allowed(np.array([size]), similarity)[0])
            rest = _open_places(size, may + 1, path)
            mixed = words.mix(token[start[row][:, None] + rest].view(np.uint64) + rest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 29)
            for at in range(may + 1):
                piece = slice(at * len(rest) // (may + 1), (at + 1) * len(rest) // (may + 1))
                value = mixed[:, piece].sum(axis=1, dtype=np.uint64)
                made = words.mix(key[row].view(np.uint64) + words.mix(value + np.uint64(at), 43), 47)
                whole = len(rest) - (piece.stop - piece.start) <= may
                more = (may + 1) ** (len(path) + 2) <= spread
                same = lambda x, k=len(row): pa.array([x] * k)
                yield pa.RecordBatch.from_arrays([_long(made), _long(h[row]), _long(root[row]), pa.array([[*path, at]] * len(row), pa.list_(pa.int32())), pa.array([may] * len(row), pa.int32()), same(whole), same(more)], _SPLIT)


def _agreeing(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines of different groups that agree, in whole cells; rows are sorted by cell."""
    cell, h, group, leaf = (table.column(c).to_numpy() for c in ("cell", "h", "root", "leaf"))
    token, start, n = _tokens(table.column("t").combine_chunks())
    after = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
    cost = np.concatenate(([0], np.cumsum(after * n)))
    found_a, found_b, i = [], [], 0
    while i < len(cell):
        j = max(i + 1, int(np.searchsorted(cost, cost[i] + STEP, "right")) - 1)
        left = np.repeat(np.arange(i, j), after[i:j])
        right = _places(np.arange(i, j) + 1, after[i:j])
        at = np.flatnonzero((group[left] != group[right]) & (leaf[left] == leaf[right]) & (n[left] == n[right]))
        left, right = left[at], right[at]
        if len(left):
            size = n[left]
            differs = token[_places(start[left], size)] != token[_places(start[right], size)]
            hit = np.add.reduceat(differs.astype(np.int64), np.cumsum(size) - size) <= _allowed(size, similarity)
            found_a.append(h[left[hit]])
            found_b.append(h[right[hit]])
        i = j
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _compare(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs in cells that arrive sorted; the last cell of a batch waits for the next."""
    kept: list[pa.Table] = []

    def edges(table: pa.Table) -> pa.RecordBatch:
        a, b = _agreeing(table, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = kept[-1].column("cell")[-1].as_py() if kept else None
        kept.append(pa.Table.from_batches([batch]))
        cell = batch.column("cell").to_numpy()
        if cell[-1] == last:
            continue
        table = pa.concat_tables(kept)
        whole = int(np.searchsorted(table.column("cell").to_numpy(), cell[-1]))
        if whole:
            yield edges(table.slice(0, whole))
        kept = [table.slice(whole)]
    if kept:
        yield edges(pa.concat_tables(kept))


def generalised(distinct: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``h``, ``cluster`` for lines that share a template with a smaller one (by hash) of their leaf.

    ``distinct`` has ``leaf``, ``h`` and ``t`` without repeats.
    """
    lined = stored(distinct)
    keyed = lined.select("leaf", "h", "t").mapInArrow(tidy(lambda batches: _pieces(batches, similarity)), "key long, h long")
    centres = keyed.groupBy("key").agg(F.min("h").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(centres, "key").select("key", "h", "centre", "n"))
    pairs = shared.where("h <> centre").select("h", "centre").distinct()
    other = lined.select(F.col("leaf").alias("l"), F.col("h").alias("centre"), F.col("t").alias("ct"))
    same = F.size(F.filter(F.zip_with("t", "ct", lambda a, b: a == b), lambda x: x))
    checked = pairs.join(lined, "h").join(other, "centre").where((F.col("leaf") == F.col("l")) & (F.size("t") == F.size("ct")))
    near = stored(checked.where(same >= F.ceil(F.size("t") * similarity - 1e-9)).select(F.col("h").alias("a"), F.col("centre").alias("b")))
    rooted = shared.join(components(near, "a", "b").withColumnRenamed("node", "h"), "h", "left").select("key", "h", "n", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = stored(rooted.join(mixed, "key").select("key", "h", "root", "n"))
    cell = CELL
    # A line may differ in one place at least, so a key this small is small whatever its lines' length.
    small = open_.where(F.col("n") <= 2 * cell)
    crowded = open_.where(F.col("n") > 2 * cell)
    if not crowded.isEmpty():
        may = F.size("t") - F.ceil(F.size("t") * similarity - 1e-9).cast("int")
        sized = stored(crowded.join(lined.select("h", may.alias("may")), "h"))
        large = F.col("n") > cell * (F.col("may") + 1)
        small = small.unionByName(sized.where(~large).select("key", "h", "root", "n"))
        links = _crowded_links(sized.where(large).select("key", "h", "root"), lined, similarity, cell, chunk)
        return components(near.unionByName(_compared(small, lined, similarity, chunk)).unionByName(links), "a", "b").select(F.col("node").alias("h"), F.col("root").alias("cluster"))
    return components(near.unionByName(_compared(small, lined, similarity, chunk)), "a", "b").select(F.col("node").alias("h"), F.col("root").alias("cluster"))


def _compared(rows: DataFrame, lined: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """``a``, ``b``: lines of a key (``key``, ``h``, ``root``, and ``n`` lines) of different groups that agree, by comparing all."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("h"), parts).cast("int")
    # A cell of the grid has two chunks of a key's lines, so any two lines meet.
    grid = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("key", F.least(i, mine), F.greatest(i, mine)))
    dealt = rows.select("h", "root", F.explode(grid).alias("cell")).join(lined, "h")
    dealt = dealt.select("cell", "h", "root", "leaf", "t").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(tidy(lambda batches: _compare(batches, similarity)), "a long, b long")


def _crowded_links(crowded: DataFrame, lined: DataFrame, similarity: float, cell: int, chunk: int) -> DataFrame:
    """``a``, ``b``: links that join what agrees among the lines of crowded keys (``key``, ``h``, ``root``)."""
    kind = "key long, h long, root long, path array<int>, may int, whole boolean, more boolean"
    pieces = lined.select("leaf", "h", "t").mapInArrow(tidy(lambda batches: _pieces(batches, similarity, True)), "key long, h long, path array<int>")
    now, links, split, spread = pieces.join(crowded, ["key", "h"]), None, True, SPREAD
    while split:
        made = stored(now.join(lined.select("h", "t"), "h").select("key", "h", "root", "path", "t").mapInArrow(tidy(lambda batches: _split(batches, similarity, spread)), kind))
        keys = made.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("centre"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 1 and a <> b")
        met = stored(made.join(keys.select("key", "n", "centre"), "key"))
        large = F.col("more") & (F.col("n") > cell * (F.col("may") + 1))
        new = met.where("whole and h <> centre").select(F.col("h").alias("a"), F.col("centre").alias("b"))
        new = new.unionByName(_compared(met.where(~F.col("whole") & ~large).select("key", "h", "root", "n"), lined, similarity, chunk))
        links = new if links is None else links.unionByName(new)
        now = met.where(~F.col("whole") & large).select("key", "h", "root", "path")
        split = not now.isEmpty()
    return links


def recurring(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Lines to drop: ``h``, ``cluster``, ``documents``, and ``first_id``, the document that keeps them.

    ``found`` is ``lines(df)``.
    """
    shown = stored(found.groupBy("leaf", "h", "print").agg(F.min("id").alias("first")))
    crowded = shown.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("n") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf")
    joined = generalised(line_tokens(df, crowded, doc_id, text), similarity)
    members = stored(joined.unionByName(joined.select(F.col("cluster").alias("h"), "cluster").distinct()))
    count = [F.count(F.lit(1)).alias("documents"), F.min("first").alias("first_id")]
    # A line on its own has a row for each text already; lines of one cluster may share texts.
    alone = shown.groupBy("h").agg(*count).where(F.col("documents") >= min_docs).join(members, "h", "left_anti").withColumn("cluster", F.col("h"))
    texts = shown.join(members, "h").groupBy("cluster", "print").agg(F.min("first").alias("first"))
    counts = texts.groupBy("cluster").agg(*count).where(F.col("documents") >= min_docs)
    return members.join(counts, "cluster").unionByName(alone).select("h", "cluster", "documents", "first_id")


def drop_recurring_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """All rows of ``df`` with the text that is left, ``n_lines`` int and ``n_dropped`` int (replaced if there)."""
    found = stored(lines(df, doc_id, text))
    drop = recurring(df, found, doc_id, text, min_docs, similarity)
    hit = found.select("id", "print", "place", "h").join(drop.select("h", "first_id"), "h").where("id <> first_id")
    # A document's dropped places; repeated rows give the same place twice, which the set joins.
    own_id, own_print, gone = unused(df.drop("n_lines", "n_dropped"), "id", "print", "places")
    places = hit.groupBy("id", "print").agg(F.collect_set(F.col("place").cast("int")).alias(gone)).withColumnsRenamed({"id": own_id, "print": own_print})
    own = df.drop("n_lines", "n_dropped").withColumns({own_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), own_print: F.xxhash64(text)})
    joined = own.join(places, [own_id, own_print], "left")
    split = F.split(F.col(text), "\n")
    # The places that stay are found by one hashed set, so a text of many lines and many drops costs their sum.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.array_join(let(split, lambda x: F.transform(stay, lambda i: F.get(x, i))), "\n")
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)))
        .withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)))
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept))
        .drop(own_id, own_print, gone)
    )
