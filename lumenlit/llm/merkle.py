"""Merkle manifest of a dataset: a digest tree for each source, and one over the sources.

Leaves get their place within their source by ranges, not by a window. Every aligned block
of ``FANOUT ** HEIGHT`` leaves is one row with its leaves as a contiguous digest matrix, so
it can be hashed by itself: a level's matrix is read in rows of ``FANOUT`` digests, each
hashed to a digest of the next level. The blocks' tops are the nodes of the next round, until
each source has one, its subroot; the subroots are the leaves of one more tree in the same
way. Then the blocks are passed from the top down: in a matrix a node's siblings are the
digests of its aligned run on either side, and what lies above a block is common to all in it.

Defined results: null ids, sources and fields are values of their own (null sorts first, a
null field is digested as ``-``); rows with equal ids are ordered by their leaves, equal
rows are leaves each; a lone leaf is its own subroot, with no siblings in its source; an
empty table gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lumenlit.llm.common import stored, tidy
from lumenlit.llm.ordered import positions

FANOUT = 16
#: Levels in a block, by default.
HEIGHT = 3
#: Bytes of a digest as hexadecimal text.
DIGEST = 64


def leaf(*fields: Column) -> Column:
    """sha256 of the fields in order, each as its UTF-8 byte count, a colon and its text, or ``-``."""
    told = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(F.coalesce(told(c.cast("string")), F.lit("-")) for c in fields)), 256)


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def levels(leaves: bytes, members: int, height: int = HEIGHT) -> list[np.ndarray]:
    """The digest matrices of a block, from its leaves to its top; ``members`` are the whole tree's leaves."""
    out = [np.frombuffer(leaves, np.uint8).reshape(-1, DIGEST)]
    while members > 1 and len(out) <= height:
        now = out[-1]
        whole = len(now) // FANOUT
        rows = [*now[: whole * FANOUT].reshape(whole, FANOUT * DIGEST), *([now[whole * FANOUT :]] if len(now) % FANOUT else [])]
        out.append(np.frombuffer(b"".join(digest(row.tobytes()) for row in rows), np.uint8).reshape(-1, DIGEST))
        members = -(-members // FANOUT)
    return out


def siblings(level: np.ndarray, node: int) -> tuple[bytes, bytes]:
    """The digests before and after a node in its aligned run."""
    first = node // FANOUT * FANOUT
    return level[first:node].tobytes(), level[node + 1 : first + FANOUT].tobytes()


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings, level by level, give."""
    for before, after in path:
        node = digest(before + node + after)
    return node


def packed_path(path: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """All siblings as one text, and how many come before and after the node at each level."""
    return b"".join(a + b for a, b in path), bytes(len(x) // DIGEST for pair in path for x in pair)


def opened_path(text: bytes, shape: bytes) -> list[tuple[bytes, bytes]]:
    at = np.concatenate(([0], np.cumsum(np.frombuffer(shape, np.uint8).astype(np.int64)))) * DIGEST
    return [(text[at[i] : at[i + 1]], text[at[i + 1] : at[i + 2]]) for i in range(0, len(shape), 2)]


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """A row for each aligned block: ``tree``, ``block``, ``members``, ``ids``, ``leaves``, ``claims``, ``top``."""
    types, span = {f.name: f.dataType for f in nodes.schema}, FANOUT**height
    out = StructType([StructField("tree", types["tree"])]).add("block", "long").add("members", "long")
    out = out.add("ids", ArrayType(types["id"])).add("leaves", "binary").add("claims", "binary").add("top", "binary")

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        leaves, claims = (b"".join(rows.column(c).to_pylist()) for c in ("digest", "claim"))
        members, first = rows.column("members")[0].as_py(), rows.column("position")[0].as_py()
        columns = [rows.column("tree").slice(0, 1).combine_chunks(), pa.array([first // span]), pa.array([members]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("id").combine_chunks())]
        columns += [pa.array([x], pa.binary()) for x in (leaves, claims, levels(leaves, members, height)[-1].tobytes())]
        return pa.Table.from_arrays(columns, [f.name for f in out])

    return nodes.groupBy("tree", F.floor(F.col("position") / span).alias("_block")).applyInArrow(block, out)


def grown(leaves: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round from the leaves up, and the roots: ``tree``, ``digest``.

    ``leaves`` has ``tree``, ``id``, ``position``, ``members``, ``digest`` and ``claim`` (64 bytes each).
    """
    rounds, nodes, span = [], leaves, FANOUT**height
    largest = leaves.agg(F.max("members")).first()[0] or 1
    while not rounds or largest > 1:
        rounds.append(stored(_blocks(nodes, height)))
        members = F.ceil(F.col("members") / span).cast("long").alias("members")
        nodes = rounds[-1].select("tree", F.col("block").alias("id"), F.col("block").alias("position"), members, F.col("top").alias("digest"), F.col("top").alias("claim"))
        largest = -(-largest // span)
    return rounds, nodes.select("tree", "digest")


#: What a leaf's row has besides its tree and id, and what is added to it on demand.
TOLD = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
PATH = ("siblings", "shape")


def walked(block: dict, height: int) -> list[tuple[bytes, bytes]]:
    """The packed path of each leaf of a block to the root: its siblings here, then what lies above the block."""
    matrices = levels(block["leaves"], block["members"], height)
    paths = [(block["siblings"], block["shape"])]
    for level in reversed(matrices[:-1]):  # each node's path is its siblings and its parent's path
        own = (packed_path([siblings(level, node)]) for node in range(len(level)))
        paths = [(a + paths[k // FANOUT][0], b + paths[k // FANOUT][1]) for k, (a, b) in enumerate(own)]
    return paths


def passed_down(rounds: list[DataFrame], above: DataFrame, paths: bool = True, told: bool = False, height: int = HEIGHT) -> DataFrame:
    """``tree``, ``id`` and ``position`` of every leaf, with the columns of ``PATH`` or ``TOLD`` as asked.

    ``above`` has a row for each tree: ``tree``, ``subroot``, ``root``, ``siblings``, ``shape``.
    """
    above = above.withColumn("position", F.lit(0).cast("long"))
    for i, blocks in reversed(list(enumerate(rounds))):
        last = i == 0
        columns = [*(TOLD if told and last else ("leaf", "subroot", "root")), *(PATH if paths or not last else ())]
        out = StructType([StructField("tree", blocks.schema["tree"].dataType), StructField("id", blocks.schema["ids"].dataType.elementType)]).add("position", "long")
        for name in columns:
            out = out.add(name, "binary" if name == "shape" or not last else "string")

        def walk(batches: Iterator[pa.RecordBatch], out: StructType = out, columns: list[str] = columns) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("block", "members", "leaves", "claims", "subroot", "root", "siblings", "shape")}
                    cut = [slice(a, a + DIGEST) for a in range(0, len(row["leaves"]), DIGEST)]
                    found, n = walked(row, height), len(cut)
                    made = {"leaf": [row["leaves"][c] for c in cut], "subroot": [row["subroot"]] * n, "root": [row["root"]] * n}
                    made |= dict(zip(PATH, map(list, zip(*found, strict=True)), strict=True))
                    if "folded_root" in columns:
                        made["proof_sha256"] = [digest(text) for text, _ in found]
                        made["folded_root"] = [folded(row["claims"][c], opened_path(*path)) for c, path in zip(cut, found, strict=True)]
                    tree = batch.column("tree").take(pa.array([i] * n, pa.int32()))
                    position = pa.array(np.arange(n) + row["block"] * FANOUT**height, pa.int64())
                    arrays = [pa.array(made[c], pa.binary()) for c in columns]
                    arrays = [x.cast(pa.string()) if out[c].dataType == StringType() else x for c, x in zip(columns, arrays, strict=True)]
                    yield pa.RecordBatch.from_arrays([tree, batch.column("ids")[i].values, position, *arrays], out.names)

        on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("position"))
        met = blocks.join(above.withColumnRenamed("tree", "_tree"), on)
        above = met.select(*blocks.columns, "subroot", "root", "siblings", "shape").mapInArrow(tidy(walk), out)
    return above


def manifest(leaves: DataFrame, paths: bool = False, height: int = HEIGHT) -> DataFrame:
    """``tree``, ``id``, ``position`` in the tree, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` and ``folded_root`` of every row.

    ``leaves`` has ``tree`` (the group), ``id`` (its order), ``digest`` and ``claim``: the
    digest that is to be verified, which may be another one; ``folded_root`` comes from it and
    the siblings of ``digest``. With ``paths`` the siblings follow from the leaf to the root
    in one text, and ``shape``: how many of them come before and after the node at each level, a byte each.
    """
    some = stored(leaves.select("tree", "id", F.col("digest").cast("binary").alias("digest"), F.col("claim").cast("binary").alias("claim")))
    rounds, subroots = grown(positions(some, "tree", ["id", "digest"]), height)
    one, nothing = F.lit(0).cast("long"), F.lit(b"")
    upper, root = grown(positions(subroots.select(one.alias("tree"), F.col("tree").alias("id"), "digest", F.col("digest").alias("claim")), "tree", ["id"]), height)
    top = root.select("tree", nothing.alias("subroot"), F.col("digest").alias("root"), nothing.alias("siblings"), nothing.alias("shape"))
    over = passed_down(upper, top, height=height)
    over = over.select(F.col("id").alias("tree"), *(F.col(c).cast("binary").alias(n) for c, n in (("leaf", "subroot"), ("root", "root"), ("siblings", "siblings"), ("shape", "shape"))))
    return passed_down(rounds, over, paths, told=True, height=height)
