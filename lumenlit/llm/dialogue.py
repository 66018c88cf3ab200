"""Structure repair of conversations: the cheapest edits that give ``(s?(ua)+)?`` by role initials.

The edits of a conversation are paths in a lattice of (turns done, what was said last). A*
walks it by (cost so far plus what the remaining turns must cost, audit): turns that must
go cost a deletion, an unfinished one costs its charge at least, and both are sums over
the turns that remain, so the bound never exceeds the truth and never falls by more than a
step costs. The first path that reaches the end is the cheapest, and of those the one with
the smallest audit.

A conversation is walked in chunks of ``CHUNK`` turns, which Spark deals out, from each
state it may be entered in to each it may be left in; one pass over the chunks of each
conversation joins them. (Audits of equal cost that lead to the same place are never one
another's beginning, so the best of the whole is made of bests of the chunks.) Turns take
their places by ranges, repeats are found by an aggregate, so a conversation of any length
is split. Only the digest of a repaired text, which sha256 defines from its first byte to its last, reads a
conversation's texts in one task, as a stream that holds one turn and the audit.

Defined results: null roles and texts are one blank, null conversations are one
conversation, null turns come first; turns of one number stand by role, then by a digest
of their text; without turns there are no faults, no edits and the digest of nothing;
other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.common import tidy
from lumenlit.llm.ordered import positions

#: Turns that are walked together.
CHUNK = 512
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
BLANKS = " \t\n\x0b\x0c\r"
#: What may be said after nothing, a system, a user and an assistant turn, and the state it leads to.
NEXT = ({"u": 2, "s": 1}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where a conversation may end.
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
Best = dict[int, tuple[int, str]]


def asked(state: int) -> str:
    """The one of user and assistant that a state waits for."""
    return "a" if state == 2 else "u"


def repairs(initials: list[str], kinds: list[int], entry: int, last: bool) -> Best:
    """Cost and audit of the best edits of some turns, by the state they end in: of all states, or of the best end alone."""
    n = len(kinds)
    due = [0] * (n + 1)  # what the turns from here on cost at least
    for i in range(n - 1, -1, -1):
        due[i] = due[i + 1] + (DELETE if kinds[i] in (BLANK, DUPLICATE) else UNFINISHED if kinds[i] == TRUNCATED else 0)
    heap, done, out = [(due[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost, moves = bound - due[i], NEXT[state]
        if i == n and (not last or state in ENDS):
            out[state] = (cost, audit)
            if last:
                break
        steps = [("I", INSERT, i, moves[asked(state)])]
        if i < n:
            steps.append(("D", DELETE, i + 1, state))
            if kinds[i] in (FINE, TRUNCATED):
                charge = UNFINISHED if kinds[i] == TRUNCATED else 0
                steps.append(("R", REROLE + charge, i + 1, moves[asked(state)]))
                if initials[i] in moves:
                    steps.append(("K", charge, i + 1, moves[initials[i]]))
        for letter, price, j, to in steps:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + price + due[j], audit + letter, j, to))
    return out


class Joined:
    """The best edits of a conversation's chunks so far; what all states' audits begin with is kept once."""

    def __init__(self) -> None:
        self.common: list[str] = []
        self.best: Best = {0: (0, "")}

    def add(self, chunk: dict[int, Best]) -> None:
        new: Best = {}
        for state, (cost, audit) in self.best.items():
            for to, (more, then) in chunk[state].items():
                new[to] = min(new.get(to, (cost + more, audit + then)), (cost + more, audit + then))
        shared = os.path.commonprefix([audit for _, audit in new.values()])
        self.common.append(shared)
        self.best = {to: (cost, audit[len(shared) :]) for to, (cost, audit) in new.items()}

    def result(self) -> tuple[int, str]:
        cost, audit = min(self.best[s] for s in ENDS if s in self.best)
        return cost, "".join([*self.common, audit])


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with the faults that the crc32 of ``conv_id:turn`` modulo 20 names.

    0 drops a turn, 1 empties its text, 2 takes its full stops, question and exclamation
    marks, 3 repeats it, 4 makes it the user's.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("lot")
    some = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), lot).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``initial``, ``kind`` (the first fault), ``position`` and ``members``, without the texts."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank, unfinished = F.length(said) == 0, ~F.right(said, F.lit(1)).isin(".", "!", "?")
    narrow = turns.select("conv_id", "turn", "role", _digest().alias("digest"), blank.alias("blank"), unfinished.alias("unfinished"))
    placed = positions(narrow, "conv_id", ["turn", "role", "digest"])
    first = placed.groupBy(F.col("conv_id").alias("_conv"), "role", "digest").agg(F.min("position").alias("_first")).select("_conv", "_first")
    # Each turn meets its own place alone, so no repeated text is a hot key.
    met = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("_first")), "left")
    kind = F.when(F.col("blank"), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(F.col("unfinished"), TRUNCATED).otherwise(FINE)
    return met.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "position", "members")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in the first columns, whatever batches they come in."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != now:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row)
    if held:
        yield now, held


CHUNKS = "first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _illegal(before: str | None, after: str) -> bool:
    return before is not None and before + after not in ("su", "ua", "au")


def edits(found: DataFrame) -> DataFrame:
    """``conv_id``, counts of faults, ``cost`` and ``audit`` for each conversation of ``faults``."""
    kind = found.schema["conv_id"].dataType.simpleString()
    chunk = F.floor(F.col("position") / CHUNK).cast("long")
    last = chunk == F.floor((F.col("members") - 1) / CHUNK)
    dealt = found.select("conv_id", chunk.alias("chunk"), last.alias("last"), "position", "turn", "initial", "kind")
    dealt = dealt.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "position")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = ["conv_id", "chunk", *(x.split()[0] for x in CHUNKS.split(", "))], []
        types = [pa.string(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv), *(pa.array(c, t) for c, t in zip(columns[1:], [pa.int64(), *types], strict=True))], names)

        conv = None

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal conv
            for batch in batches:
                conv = batch.column(0).type
                yield batch

        for (conv_id, chunk, last), run in _runs(seen(batches), 3):
            initials, kinds = [r[5] for r in run], [r[6] for r in run]
            best = {entry: repairs(initials, kinds, entry, last) for entry in (range(4) if chunk else (0,))}
            flat = [(entry, to, *x) for entry, ends in best.items() for to, x in ends.items()]
            numbers = [r[4] for r in run if r[4] is not None]
            counts = [kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(_illegal(a, b) for a, b in zip(initials[:-1], initials[1:], strict=True))
            rows.append((conv_id, chunk, initials[0], initials[-1], numbers[0] if numbers else None, numbers[-1] if numbers else None, len(set(numbers)), *counts, illegal, *map(list, zip(*flat, strict=True))))
            if len(rows) >= 1000:
                yield told()
                rows.clear()
        if rows:
            yield told()

    chunks = dealt.mapInArrow(tidy(walked), f"conv_id {kind}, chunk long, {CHUNKS}").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, conv = None, None, None

        def told() -> pa.RecordBatch:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            cost, audit = state["joined"].result()
            values = [gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost]
            return pa.RecordBatch.from_arrays([pa.array([now], conv), *(pa.array([v], pa.int64()) for v in values), pa.array([audit], pa.string())], ["conv_id", *STATS, "audit"])

        for batch in batches:
            conv = batch.column(0).type
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        yield told()
                    now, state = row["conv_id"], {"low": None, "high": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "joined": Joined()}
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    state[c] += row[c]
                state["illegal"] += _illegal(state["last"], row["first"])
                state["turns"] -= row["low"] is not None and row["low"] == state["high"]
                state["low"] = row["low"] if state["low"] is None else state["low"]
                state["high"] = state["high"] if row["high"] is None else row["high"]
                state["last"] = row["last"]
                best: dict[int, Best] = {}
                for entry, to, cost, audit in zip(row["entries"], row["exits"], row["costs"], row["audits"], strict=True):
                    best.setdefault(entry, {})[to] = (cost, audit)
                state["joined"].add({e: best.get(e, {}) for e in range(4)})
        if state is not None:
            yield told()

    return chunks.mapInArrow(tidy(joined), f"conv_id {kind}, {', '.join(f'{c} long' for c in STATS)}, audit string")


class Script:
    """A repaired conversation's digest, turn by turn."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, 0, sha256(), False

    def say(self, letter: str, role: str, text: str) -> None:
        self.state = NEXT[self.state][letter]
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.say(asked(self.state), ROLES[asked(self.state)], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.say(role[:1], role, text)
        elif edit == "R":
            self.say(asked(self.state), ROLES[asked(self.state)], text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def repaired(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """A row for each conversation of ``everyone``: counts of faults, ``cost``, ``audit`` and ``repaired_sha256``."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    told = edits(faults(turns)).withColumnRenamed("conv_id", "_conv")
    heads = everyone.select("conv_id").join(told, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    heads = heads.select("conv_id", F.lit(0).alias("mark"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.coalesce("audit", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("digest"), *(F.coalesce(c, F.lit(0)).alias(c) for c in STATS))
    texts = turns.select("conv_id", F.lit(1).alias("mark"), "turn", "role", "text", _digest().alias("digest"), *(F.lit(None).cast("long").alias(c) for c in STATS))
    met = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "mark", "turn", "role", "digest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, head, conv, rows = None, None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv), *(pa.array(c, pa.int64()) for c in columns[1:-2]), *(pa.array(c, pa.string()) for c in columns[-2:])], ["conv_id", *STATS, "audit", "repaired_sha256"])

        for batch in batches:
            conv = batch.column(0).type
            for conv_id, mark, role, text, *stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mark:
                    script.turn(role, text)
                    continue
                if script:
                    rows.append((*head, script.digest()))
                if len(rows) >= 1000:
                    yield told()
                    rows.clear()
                script, head = Script(text), (conv_id, *stats, text)
        if script:
            rows.append((*head, script.digest()))
        if rows:
            yield told()

    return met.select("conv_id", "mark", "role", "text", *STATS).mapInArrow(tidy(read), f"conv_id {kind}, {', '.join(f'{c} long' for c in STATS)}, audit string, repaired_sha256 string")
