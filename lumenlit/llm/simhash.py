"""SimHash near-dedup by anchor points of a covering code.

The 64 bits of a fingerprint fall into three blocks; if two fingerprints differ in at
most four bits, some block differs in at most one. For each block the anchors are a
covering code: the perfect Hamming code of length 15 (covering radius 1) times all values
of the remaining 6 or 7 bits. A fingerprint is at home at its nearest anchor and is
replicated to every anchor within covering radius plus threshold, 1 + 1 bits; so the
home of one of any two linked fingerprints also gets the other. Per anchor, homes are
compared with all replicas over all 64 bits.

Only distinct fingerprints are compared, and an anchor returns a spanning forest of its
links (a row for each linked fingerprint), never all pairs. Anchors with more replicas
than ``CHUNK`` are cut into a grid of home chunks and replica chunks, so a task never
holds an unbounded anchor and no link is lost. There are 524,288 anchors at most, which
bounds the broadcast list of the crowded ones.

Defined results: null and white-space texts have fingerprint 0 and are linked like any
other; texts shorter than a shingle are one shingle; repeated rows share a fingerprint; an
empty table gives an empty one; other columns of the input, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lumenlit.llm import words
from lumenlit.llm.common import persisted
from lumenlit.operators.graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Length of the Hamming code in each block.
CODE = 15
#: Replicas of an anchor which are compared in one piece.
CHUNK = 8192
#: Pairs compared in one step.
PAIRS = 1 << 21
#: Shingles whose bits are counted in one step.
STEP = 1 << 15


def simhashes(text: str | None, shingle: int = SHINGLE, width: int = 1) -> np.ndarray:
    """The fingerprint of a text as ``width`` unsigned 64-bit numbers; the first is that of XXH64 itself."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not tokens:
        return np.zeros(width, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shingle + 1)
    last = ends[min(shingle, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64 * width, np.int64)
    for i in range(0, n, STEP):
        first = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + STEP)].tolist(), last[i : i + STEP].tolist(), strict=True)], "<u8")
        hashes = np.stack([first, *(words.mix(first, salt) for salt in range(1, width))], axis=1).astype("<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(len(first), 8 * width), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    return int(simhashes(text, shingle).view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), shingle) for t in texts], pa.int64())

    return arrow_udf(of, "long")(text)


def hexed(fingerprint_column: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint_column)), 16, "0")


def _syndrome(code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(code), np.int64)
    for i in range(CODE):
        out ^= np.where(code >> i & 1, i + 1, 0)
    return out


def _near_codewords(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, codeword and distance for all codewords within two bits of each value."""
    s = _syndrome(code)
    rows, words, far = [np.arange(len(code))], [np.where(s > 0, code ^ (1 << np.maximum(s - 1, 0)), code)], [(s > 0).astype(np.int64)]
    for i in range(1, CODE + 1):
        j = i ^ s
        at = np.flatnonzero((j > i) & (s > 0) & (i != s) & (j != s))
        rows.append(at)
        words.append(code[at] ^ (1 << (i - 1)) ^ (1 << (j[at] - 1)))
        far.append(np.full(len(at), 2))
    return tuple(map(np.concatenate, (rows, words, far)))


def _anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one word: all anchors within two bits in each block."""
    bits = fingerprints.view(np.uint64)
    rows, keys, homes = [], [], []
    for block, (first, width) in enumerate(BLOCKS):
        value = (bits >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        rest = width - CODE
        row, word, far = _near_codewords(value & (1 << CODE) - 1)
        upper = value >> CODE
        flips = [0, *(1 << i for i in range(rest)), *(1 << i | 1 << j for i in range(rest) for j in range(i))]
        for flip in flips:
            weight = flip.bit_count()
            at = np.flatnonzero(far + weight <= 2)
            rows.append(row[at])
            keys.append(block << 22 | (upper[row[at]] ^ flip) << CODE | word[at])
            homes.append((weight == 0) & (far[at] <= 1))
    return tuple(map(np.concatenate, (rows, keys, homes)))


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the home, over all words (columns) of the fingerprints."""
    each = [_anchors(np.ascontiguousarray(word)) for word in fingerprints.reshape(len(fingerprints), -1).T]
    return np.concatenate([r for r, _, _ in each]), np.concatenate([k | i << 24 for i, (_, k, _) in enumerate(each)]), np.concatenate([h for _, _, h in each])


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(column, np.int64)).view(np.uint64)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(i, 4096)
            row, key, home = anchors(_words(fp))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), fp.take(pa.array(row))], ["anchor", "home", "fp"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            _, key, _ = anchors(_words(batch.column(0).slice(i, 4096)))
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["anchor", "n"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        before = label.copy()
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def _linked(fp: np.ndarray, key: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links in whole cells; rows are sorted by cell."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    cell = np.repeat(np.arange(len(start)), size)
    at = np.flatnonzero(home & (size[cell] > 1))
    work = size[cell[at]]
    found_a, found_b, i = [], [], 0
    name = fp.view(np.int64)
    cut = np.concatenate(([0], np.cumsum(work)))
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + PAIRS, "right")) - 1)
        mine, n = at[i:j], work[i:j]
        left = np.repeat(mine, n)
        right = np.arange(len(left)) - np.repeat(cut[i:j] - cut[i], n) + np.repeat(start[cell[mine]], n)
        far = np.bitwise_count(fp[left] ^ fp[right])
        hit = (far <= most) & (far > 0)
        if hit.any():
            x, y = _forest(name[left[hit]], name[right[hit]])
            found_a.append(x)
            found_b.append(y)
        i = j
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of cells that arrive sorted; the last cell of a batch waits for the next."""
    kept: list[pa.Table] = []

    def edges(table: pa.Table) -> pa.RecordBatch:
        cell = table.column("cell").to_numpy()
        a, b = _linked(_words(table.column("fp")), cell, table.column("home").to_numpy(), most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        cell = batch.column("cell").to_numpy()
        whole = int(np.searchsorted(cell, cell[-1]))
        if not whole and len(kept) == 1 or sum(t.num_rows for t in kept) < 100_000:
            continue
        table = pa.concat_tables(kept)
        cells = table.column("cell").to_numpy()
        whole = int(np.searchsorted(cells, cells[-1]))
        if whole:
            yield edges(table.slice(0, whole))
        kept = [table.slice(whole)]
    if kept:
        yield edges(pa.concat_tables(kept))


def links(distinct: DataFrame, column: str = "fp", chunk: int = CHUNK, most: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` that connect what is linked among distinct fingerprints (longs)."""
    fps = distinct.select(F.col(column).alias("fp"))
    replicas = fps.mapInArrow(_replicas, "anchor long, home boolean, fp long")
    crowded = fps.mapInArrow(_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > chunk)
    crowded = crowded.select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    sized = replicas.join(F.broadcast(crowded), "anchor", "left")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    # A home meets each chunk of replicas; in the grid both sides are cut.
    as_home = sized.where("home").select("anchor", "fp", F.lit(True).alias("home"), F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(every, lambda j: mine * F.col("parts") + j))).alias("part"))
    as_replica = sized.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(every, lambda i: i * F.col("parts") + mine))).alias("part"))
    cells = as_home.unionByName(as_replica).withColumn("cell", F.col("anchor") * F.lit(1 << 32) + F.col("part"))
    sorted_cells = cells.select("cell", "home", "fp").repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(lambda batches: _compare(batches, most), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` long, ``root`` (smallest fingerprint reachable) and ``component_id`` (smallest id reachable) for each row."""
    printed = persisted(df.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct), "a", "b")
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return printed.join(labelled.join(smallest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")
