"""Language-model scores from a hidden Markov model trained by Baum-Welch over the corpus.

Words are counted over all training documents. A word that makes up at least one
``SYMBOLS``-th of all tokens is a symbol of its own (so there are at most ``SYMBOLS``),
any other word belongs to one of ``CLASSES`` classes by its last letters. The model's
states emit symbols and classes; a word within its class has the smoothed share of its
count, the same in every state: an ordinary hidden Markov model over words with tied
emissions, which sums to one, whose state-dependent part is bounded by constants.

States start from all training documents, each of which gives its counts to the state
that its words point to (on which side of some seeded random planes through the corpus's
mean they lie); then every Baum-Welch round makes expected counts of all training
documents in Spark's tasks, sums them over tasks by symbol, and re-estimates. Scores are
the exact likelihood by the scaled forward recursion, plus the shares of words in their
classes, for which rare words are joined to their counts; only words that make up a
``KNOWN``-th of all tokens or more (at most ``KNOWN`` of them) are sent to the tasks.

A word is known by 54 bits of a hash and its class. Defined results: null and empty texts
are the end token alone; without training rows the counts are zero and states uniform;
repeated rows score alike; texts of any length are read whole, very long ones in parts
that are walked side by side; other columns of the input, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm import words
from lumenlit.llm.common import persisted, tidy

STATES = 8
SYMBOLS = 1 << 16
KNOWN = 1 << 20
CLASSES = 1024
ROUNDS = 2
#: Weight, in tokens, of the unigram model in each state's emissions.
PRIOR = 200.0
#: Texts taken out of an Arrow batch at once, and bytes of text walked side by side.
STEP = 2048
PORTION = 6 << 20
#: Bytes of a long text whose words are taken at once; symbols of a text above which it is
#: walked in parts, and symbols of these whose states are kept at once.
BLOCK, LONG, SIDE = 4 << 20, 1 << 17, 1 << 19


@dataclass(frozen=True)
class Lexicon:
    """Counts: frequent words by sorted key, and the totals of the rest of each class."""

    keys: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray  # of each key, or -1
    symbols: int  # number of words that are symbols
    ends: int
    tokens: int
    distinct: int
    class_mass: np.ndarray

    @property
    def unigram(self) -> np.ndarray:
        """Share of the end token (0), of each symbol and of each class."""
        mass = np.concatenate(([self.ends + 0.5], np.zeros(self.symbols), self.class_mass))
        own = self.symbol > 0
        mass[self.symbol[own]] = self.counts[own] + 0.5
        return mass / mass.sum()


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # a row for each symbol, a column for each state


def _keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of some bytes (class in the lowest bits), and where they begin."""
    data = words.LOWER[data]
    a, b = words.spans(data)
    tail = np.zeros(len(a), np.uint64)
    for i in (1, 2, 3):
        inside = b - i >= a
        tail = tail << np.uint64(8) | np.where(inside, data[np.maximum(b - i, 0)], 0).astype(np.uint64)
    return words.hashes(data, a, b) & ~np.uint64(CLASSES - 1) | words.mix(tail, 7) % np.uint64(CLASSES), a


def _cuts(text: bytes) -> Iterator[np.ndarray]:
    """A text in blocks of about ``BLOCK`` bytes that end in white space."""
    at = 0
    while at < len(text):
        stop = min(at + BLOCK, len(text))
        while stop < len(text) and not words.SPACE[text[stop - 1]]:
            some = np.flatnonzero(words.SPACE[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - stop), stop)])
            stop = stop + int(some[0]) + 1 if len(some) else min(stop + BLOCK, len(text))
        yield np.frombuffer(text, np.uint8, stop - at, at)
        at = stop


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words (class in the lowest bits), and the index of each text's first word."""
    if len(texts) == 1 and len(texts[0] or b"") > BLOCK:  # a long text is taken apart
        key = np.concatenate([_keys(block)[0] for block in _cuts(texts[0])])
        return key, np.array([0, len(key)])
    raw, first = words.buffer(texts)
    key, begin = _keys(raw)
    return key, np.searchsorted(begin, first)


def _find(lexicon: Lexicon, key: np.ndarray) -> np.ndarray:
    """Place of each key among the frequent words, or -1."""
    if not len(lexicon.keys):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(lexicon.keys, key), len(lexicon.keys) - 1)
    return np.where(lexicon.keys[at] == key, at, -1)


def sequence(lexicon: Lexicon, key: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each closed by the end token, and where each text begins."""
    own = np.where(at >= 0, lexicon.symbol[at] if len(lexicon.symbol) else -1, -1)
    symbol = np.where(own > 0, own, 1 + lexicon.symbols + (key % np.uint64(CLASSES)).astype(np.int64))
    n = len(bounds) - 1
    out = np.zeros(len(key) + n, np.int64)
    out[np.arange(len(key)) + np.repeat(np.arange(n), np.diff(bounds))] = symbol
    return out, bounds + np.arange(n + 1)


def _walk(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length, where they begin, and how many are longer than t."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    return order, bounds[:-1][order], np.searchsorted(-length[order], -np.arange(longest), "left")


def _apart(bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which texts are walked side by side, and begin and end of the long ones."""
    long = np.flatnonzero(np.diff(bounds) > LONG)
    return long, [(int(bounds[i]), int(bounds[i + 1])) for i in long]


def forward(model: Model, symbol: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text's symbols."""
    long, spans = _apart(bounds)
    if len(long):
        short = np.delete(np.arange(len(bounds) - 1), long)
        out = np.empty(len(bounds) - 1)
        out[long] = [Parts(model, symbol[a:b]).log10 for a, b in spans]
        if len(short):
            some = np.concatenate([symbol[bounds[i] : bounds[i + 1]] for i in short])
            out[short] = forward(model, some, np.concatenate(([0], np.cumsum(np.diff(bounds)[short]))))
        return out
    order, begin, still = _walk(bounds)
    scale = np.empty(len(symbol))
    now = np.empty((0, len(model.start)))
    for t, n in enumerate(still):
        at = begin[:n] + t
        now = model.emit[symbol[at]] * (model.start if t == 0 else now[:n] @ model.step)
        s = now.sum(axis=1)
        scale[at] = s
        now /= s[:, None]
    return np.add.reduceat(np.log10(scale), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


class Parts:
    """The recursions over one long text, cut into about as many parts as each has symbols.

    The parts' step matrices are multiplied side by side, which gives what enters each part
    from either end; so a text takes steps in the order of the square root of its length,
    and no more than ``SIDE`` symbols have their states' weights kept at once.
    """

    def __init__(self, model: Model, symbol: np.ndarray) -> None:
        # The first symbol comes from the start, each other one from a step.
        self.model, self.symbol, n, k = model, symbol, len(symbol) - 1, len(model.start)
        first = model.start * model.emit[symbol[0]]
        self.length = max(1, int(np.ceil(np.sqrt(n))))
        self.count, self.n = -(-n // self.length), n
        self.group = max(1, SIDE // self.length)
        product, worth = np.empty((self.count, k, k)), np.zeros(self.count)
        for a, b in self.groups():
            now = np.broadcast_to(np.eye(k), (b - a, k, k))
            for t in range(self.length):
                emit, there = self.emitted(a, b, t)
                new = (now.reshape(-1, k) @ model.step).reshape(now.shape) * emit[:, None, :]
                total = new.sum(axis=(1, 2))
                now = np.where(there[:, None, None], new / total[:, None, None], now)
                worth[a:b] += np.where(there, np.log10(total), 0.0)
            product[a:b] = now
        self.enter, self.leave = np.ones((self.count + 1, k)), np.ones((self.count + 1, k))
        self.enter[0] = first / first.sum()
        logs = [np.log10(first.sum()), worth.sum()]
        for i in range(self.count):
            ahead = self.enter[i] @ product[i]
            logs.append(np.log10(ahead.sum()))
            self.enter[i + 1] = ahead / ahead.sum()
        for i in range(self.count - 1, -1, -1):
            back = product[i] @ self.leave[i + 1]
            self.leave[i] = back / back.sum()
        self.log10 = float(sum(logs))

    def groups(self) -> Iterator[tuple[int, int]]:
        return ((a, min(a + self.group, self.count)) for a in range(0, self.count, self.group))

    def emitted(self, a: int, b: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The states' emissions of symbol ``t`` of some parts, and which of them have one."""
        place = np.arange(a, b) * self.length + t
        return self.model.emit[self.symbol[1 + np.minimum(place, self.n - 1)]], place < self.n

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step, k = self.model.step, len(self.model.start)
        starts = self.enter[0] * self.leave[0]
        starts = starts / starts.sum()
        steps, emits = np.zeros((k, k)), np.zeros((len(self.model.emit), k))
        emits[self.symbol[0]] += starts
        for a, b in self.groups():
            alpha = np.empty((self.length + 1, b - a, k))
            alpha[0] = self.enter[a:b]
            for t in range(self.length):
                emit, there = self.emitted(a, b, t)
                new = (alpha[t] @ step) * emit
                alpha[t + 1] = np.where(there[:, None], new / new.sum(axis=1, keepdims=True), alpha[t])
            beta = self.leave[a + 1 : b + 1]
            for t in range(self.length - 1, -1, -1):
                emit, there = self.emitted(a, b, t)
                ahead = emit * beta
                both = ((alpha[t] @ step) * ahead).sum(axis=1)
                at = np.flatnonzero(there)
                steps += (alpha[t][at] / both[at, None]).T @ ahead[at]
                state = alpha[t + 1] * beta
                alpha[t + 1] = state / state.sum(axis=1, keepdims=True)  # from here on the symbol's states
                back = ahead @ step.T
                beta = np.where(there[:, None], back / back.sum(axis=1, keepdims=True), beta)
            first, last = a * self.length, min(b * self.length, self.n)
            held = alpha[1:].transpose(1, 0, 2).reshape(-1, k)[: last - first]
            some = self.symbol[1 + first : 1 + last]
            emits += np.stack([np.bincount(some, held[:, i], len(emits)) for i in range(k)], axis=1)
        return starts, steps * step, emits


def expected(model: Model, symbol: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, steps and emissions, by forward and backward recursions."""
    long, spans = _apart(bounds)
    if len(long):
        found = [Parts(model, symbol[a:b]).expected() for a, b in spans]
        short = np.delete(np.arange(len(bounds) - 1), long)
        if len(short):
            some = np.concatenate([symbol[bounds[i] : bounds[i + 1]] for i in short])
            found.append(expected(model, some, np.concatenate(([0], np.cumsum(np.diff(bounds)[short])))))
        return tuple(sum(x) for x in zip(*found, strict=True))
    order, begin, still = _walk(bounds)
    k = len(model.start)
    alpha, scale = np.empty((len(symbol), k)), np.empty(len(symbol))
    for t, n in enumerate(still):
        at = begin[:n] + t
        p = model.emit[symbol[at]] * (model.start if t == 0 else alpha[at - 1] @ model.step)
        scale[at] = p.sum(axis=1)
        alpha[at] = p / scale[at][:, None]
    steps = np.zeros((k, k))
    beta = np.ones((len(begin), k))
    for t in range(len(still) - 2, -1, -1):
        n = still[t + 1]
        at = begin[:n] + t
        ahead = model.emit[symbol[at + 1]] * beta[:n] / scale[at + 1][:, None]
        steps += alpha[at].T @ ahead
        beta[:n] = ahead @ model.step.T
        alpha[at] *= beta[:n]
    starts = alpha[bounds[:-1]].sum(axis=0)
    emits = np.stack([np.bincount(symbol, alpha[:, i], len(model.emit)) for i in range(k)], axis=1)
    return starts, steps * model.step, emits


def estimated(unigram: np.ndarray, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray) -> Model:
    emit = (emits + PRIOR * unigram[:, None]) / (emits.sum(axis=0) + PRIOR)
    steps = steps + 0.1
    return Model((starts + 0.5) / (starts + 0.5).sum(), steps / steps.sum(axis=1, keepdims=True), emit)


def planes(symbols: int, states: int) -> np.ndarray:
    """A side (1 or -1) of each symbol for each of the planes that part documents into ``states``."""
    bits = max(1, (states - 1).bit_length())
    h = words.mix(np.arange(symbols, dtype=np.uint64), 23)
    return np.stack([(h >> np.uint64(8 * i) & np.uint64(1)).astype(float) * 2 - 1 for i in range(bits)], axis=1)


def parted(unigram: np.ndarray, states: int, symbol: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of starts, steps and emissions if every document is in one state from end to end."""
    side = planes(len(unigram), states)
    length = np.diff(bounds)
    value = np.stack([np.add.reduceat(side[:, i][symbol], bounds[:-1]) - length * (unigram @ side[:, i]) for i in range(side.shape[1])], axis=1)
    state = (value > 0) @ (1 << np.arange(side.shape[1])) % states
    emits = np.bincount(symbol * states + np.repeat(state, length), minlength=len(unigram) * states).reshape(-1, states)
    return np.bincount(state, minlength=states).astype(float), np.diag(np.bincount(state, length - 1, states)), emits.astype(float)


def begun(unigram: np.ndarray, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray) -> Model:
    """The first model: documents stay in a state mostly, and a fifth of what a state says is what all say."""
    total = emits.sum(axis=0)
    steps = steps + (0.05 * steps.sum() + 1) / len(starts) ** 2
    return estimated(unigram, starts + 1, steps, emits + 0.25 * total * unigram[:, None])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, slice, list]]:
    for whole in batches:
        for i in range(0, whole.num_rows, STEP):
            batch = whole.slice(i, STEP)
            texts = batch.column("text").to_pylist()
            for part in words.portions(texts, PORTION):
                yield batch, part, texts[part]


def counted(training: DataFrame) -> DataFrame:
    """``key``, ``n``: how often each word is in the training documents (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for _, _, texts in _batches(batches):
            held.append(np.unique(tokens(texts)[0], return_counts=True))
            if sum(len(k) for k, _ in held) > 3_000_000:
                held = [joined()]
                if len(held[0][0]) > 1_500_000:
                    yield rows(*held[0])
                    held = []
        if held:
            yield rows(*joined())

    return training.select("text").mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """What the tasks need of the counts; the rows taken to the driver are bounded by ``KNOWN`` and ``CLASSES``."""
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total += ends
    own = F.col("n") >= max(1.0, total / SYMBOLS)
    got = counts.where(F.col("n") >= max(1.0, total / KNOWN)).toArrow()
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    is_own = n >= max(1.0, total / SYMBOLS)
    symbol = np.where(is_own, np.cumsum(is_own), -1)
    rest = counts.where(~own).groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    mass = np.full(CLASSES, 0.5)
    for r in rest.collect():
        mass[r["c"]] = r["n"] + 0.5 * (r["v"] + 1)
    return Lexicon(keys, n, symbol, int(is_own.sum()), ends, total, distinct + (ends > 0), mass)


def gathered(training: DataFrame, lex: Lexicon, model: Model | None, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts over all training documents, summed by symbol over the tasks: those of ``parted`` without a model, else expected ones."""
    shared = training.sparkSession.sparkContext.broadcast((lex, model))
    names = [f"c{i}" for i in range(states)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        unigram = lex.unigram
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states))]
        for _, _, texts in _batches(batches):
            key, bounds = tokens(texts)
            seen = sequence(lex, key, bounds, _find(lex, key))
            for s, x in zip(sums, expected(model, *seen) if model else parted(unigram, states, *seen), strict=True):
                s += x
        used = np.flatnonzero(sums[2].any(axis=1))
        table = np.concatenate([sums[0][None], sums[1], sums[2][used]])
        index = np.concatenate((np.arange(-states - 1, 0), used))
        yield pa.RecordBatch.from_arrays([pa.array(index), *(pa.array(table[:, i].copy()) for i in range(states))], ["symbol", *names])

    made = training.select("text").mapInArrow(tidy(work), "symbol long, " + ", ".join(f"{c} double" for c in names))
    got = made.groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # a row for each symbol
    index, table = got.column("symbol").to_numpy(), np.stack([got.column(c).to_numpy() for c in names], axis=1)
    full = np.zeros((len(lex.unigram) + states + 1, states))
    full[index + states + 1] = table
    return full[0], full[1 : states + 1], full[states + 1 :]


def trained(training: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """A first model from all training documents, then rounds of Baum-Welch over all of them."""
    model = begun(lex.unigram, *gathered(training, lex, None, states))
    for _ in range(rounds):
        model = estimated(lex.unigram, *gathered(training, lex, model, states))
    return model


def scored(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row of ``docs``.

    A task sends one row for each document and one for each of its rare words; rare
    words meet their counts in a join and the sums meet in a grouping by document.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))
    base_mass = math.log10(lex.tokens + 0.5 * (lex.distinct + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        worth = np.log10(lex.counts + 0.5) if len(lex.counts) else np.zeros(1)
        class_mass = np.log10(lex.class_mass)
        end = math.log10(lex.ends + 0.5)
        names = ["row", "doc_id", "key", "times", "n", "known", "words", "symbols"]
        for batch, part, texts in _batches(batches):
            rows = batch.column("row").to_numpy()[part]
            key, bounds = tokens(texts)
            at = _find(lex, key)
            value = forward(model, *sequence(lex, key, bounds, at))
            text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            frequent = at >= 0
            sums = np.bincount(text_of, np.where(frequent, worth[at], 0), len(texts))
            in_class = ~frequent | ((lex.symbol[at] if len(lex.symbol) else -1) < 0)
            share = np.where(frequent, worth[at], 0) - class_mass[(key % np.uint64(CLASSES)).astype(np.int64)]
            symbols = value + np.bincount(text_of, np.where(in_class, share, 0), len(texts))
            n = np.diff(bounds) + 1
            known = np.bincount(text_of, frequent, len(texts)).astype(np.int64) + (lex.ends > 0)
            ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
            cols = [rows, ids, -1 - rows, np.zeros(len(rows), np.int32), n, known, sums + end, symbols]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)
            rare = np.flatnonzero(~frequent)
            k, d = key[rare], text_of[rare]
            order = np.lexsort((k, d))
            k, d = k[order], d[order]
            new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(k)))
            for i in range(0, len(new), 200_000):
                some = new[i : i + 200_000]
                none = pa.nulls(len(some), pa.int64())
                nothing = pa.nulls(len(some), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[d[some]]), none, pa.array(k[some].view(np.int64)), pa.array(times[i : i + 200_000].astype(np.int32)), none, none, nothing, nothing], names)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    found = numbered.mapInArrow(tidy(work), "row long, doc_id long, key long, times int, n long, known long, words double, symbols double")
    rare = counts.where(F.col("n") < max(1.0, lex.tokens / KNOWN)).select("key", F.col("n").alias("c"))
    # A document's own row has a key below zero by its number; words that hash below zero can't be confused with it, as times is 0.
    met = found.join(rare, "key", "left")
    worth = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)))
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("times") > 0, F.when(F.col("c") > 0, F.col("times")).otherwise(0)).otherwise(0))).alias("n_known"),
        (F.max("words") + F.coalesce(F.sum(worth), F.lit(0.0)) - F.max("n") * F.lit(base_mass)).alias("base_score"),
        (F.max("symbols") + F.coalesce(F.sum(worth), F.lit(0.0))).alias("score"),
    )
    return sums.drop("row")


def language_scores(docs: DataFrame, training: str = "training", doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Lexicon, Model]:
    """Scores of all rows of ``docs`` by a model of those whose column ``training`` is true."""
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(training).alias("training"))
    taught = table.where("training")
    counts = persisted(counted(taught))
    lex = lexicon(counts, taught.count())
    model = trained(taught, lex)
    return scored(table, counts, lex, model), lex, model
