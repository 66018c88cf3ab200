"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are shape counts of the line itself and of its
neighbours. The field is trained on a bounded sample of labelled documents, whose lines
take the label of the document; scaled forward-backward gives each line's marginal, and a
document's raw quality is the mean of them weighted by line length, which a logistic
curve fitted on the same sample turns into the score.

The sample is taken in the order of hashed ids: labelled documents as long as there are
no more than ``max_documents`` and their texts have no more than ``max_bytes`` and
``max_lines`` together (one that is too long for what is left is passed over); those
bounds, documented parameters, are what the driver holds. In the fit both labels weigh alike, and a
document weighs as ``MAX_LINES`` lines at most, so one very long text can't decide it.
Scoring reads every whole text, in portions of bounded bytes and lines; a text of more than
``LINES`` lines is walked in parts, with the same result.

Defined results: null and empty texts are one empty line and get a score as any other;
null labels aren't learnt from; repeated rows are learnt from once; without any label of
both kinds every score is the prior (0.5 without labels); repeated rows score alike; other
columns, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lumenlit.llm import words
from lumenlit.llm.common import release, tidy

MAX_DOCUMENTS = 6000
MAX_BYTES = 32 << 20
#: Lines that a document counts as at most in the fit.
MAX_LINES = 20
THRESHOLD = 0.3
#: Lines of the sample, together: some 600 bytes each on the driver.
MAX_SAMPLED_LINES = 1 << 19
#: Texts taken out of an Arrow batch at once; bytes and lines of text that are worked on together.
STEP = 512
PART, LINES = 1 << 20, 1 << 16
#: Shape features of a line, each repeated for the line before and after.
SHAPE = ("bias", "bytes", "words", "capitals", "marks", "exclaims", "bars", "symbols", "digits", "again", "distinct", "word_length", "ended", "empty", "repeated")
WIDTH = 3 * len(SHAPE) + 2
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # capitals
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[list(b"!?")] = 4
_KIND[list(b"|~_/\\<>{}[]=")] = 5
_KIND[list(b"$%&*#@^+")] = 6
_KIND[list(b".,;:'\"()-")] = 7
_KIND[128:] = 8


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[end] - total[start]


def _counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the line of each, how many each line has, and a hash of each line as a set of words."""
    a, b = words.spans(data)
    h = words.hashes(data, a, b)
    line = np.searchsorted(starts, a, "right") - 1
    whole = np.zeros(len(starts), np.uint64)
    np.add.at(whole, line, words.mix(h, 1))
    return h, line, np.bincount(line, minlength=len(starts)), whole


def _shape(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, line: np.ndarray, n: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """The shape features of lines, each ended by a newline."""
    kind = _KIND[data]
    count = {k: _sums(kind == k, starts, ends) for k in range(1, 9)}
    size = ends - starts
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line, same, minlength=len(starts))
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], fresh, minlength=len(starts))
    letters = np.maximum(count[1] + count[2] + count[8], 1)
    of_bytes, of_words = np.maximum(size, 1), np.maximum(n, 1)
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)], 0)
    return np.stack(
        [
            np.ones(len(starts)),
            np.log1p(size) / 8,
            np.log1p(n) / 6,
            np.sqrt(count[1] / letters),
            np.sqrt(count[7] / of_bytes),
            np.sqrt(count[4] / of_bytes),
            np.sqrt(count[5] / of_bytes),
            np.sqrt(count[6] / of_bytes),
            np.sqrt(count[3] / of_bytes),
            np.sqrt(again / of_words),
            distinct / of_words,
            np.log1p(size / of_words) / 4,
            np.isin(last, list(b".!?")).astype(float),
            (n == 0).astype(float),
            repeated,
        ],
        axis=1,
    ).astype(np.float32)


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, their byte lengths, and where each text's lines begin."""
    data, first = words.buffer(texts)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    bounds = np.append(np.searchsorted(starts, first[:-1]), len(starts))
    h, line, n, whole = _counts(data, starts)
    document = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((np.arange(len(starts)), whole, document))
    repeated = np.zeros(len(starts))
    repeated[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (document[order][1:] == document[order][:-1]) & (n[order][1:] > 0)
    shape = _shape(data, starts, ends, h, line, n, repeated)
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    before[1:], after[:-1] = shape[:-1], shape[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    lines = np.diff(bounds)
    place = np.stack([np.repeat(np.log1p(lines) / 6, lines), np.repeat(1 / lines, lines)], axis=1).astype(np.float32)
    return np.concatenate([shape, before, after, place], axis=1), ends - starts + 1, bounds


@dataclass(frozen=True)
class Field:
    """Weights of the line features for the state good, of the four transitions, and of the curve."""

    weights: np.ndarray
    steps: np.ndarray
    curve: tuple[float, float]


def marginals(emit: np.ndarray, bounds: np.ndarray, steps: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions (2 x 2, summed by the texts' weights) and log-partition of each text.

    ``emit`` has the log-potential of good (bad: 0); texts are walked side by side, and
    each step is scaled, so long texts neither overflow nor vanish.
    """
    lines = np.diff(bounds)
    order = np.argsort(-lines, kind="stable")
    begin, length = bounds[:-1][order], lines[order]
    still = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # texts with more than t lines
    e = np.exp(steps)
    shift = np.maximum(emit, 0)
    local = np.stack([np.exp(-shift), np.exp(emit - shift)], axis=1)
    alpha = np.zeros((len(emit), 2))
    scale = np.ones(len(emit))
    for t, n in enumerate(still):
        at = begin[:n] + t
        p = local[at] if t == 0 else (alpha[at - 1] @ e) * local[at]
        scale[at] = p.sum(axis=1)
        alpha[at] = p / scale[at][:, None]
    beta = np.ones((len(emit), 2))
    moves = np.zeros((2, 2))
    own = np.ones(len(lines)) if weight is None else weight[order]
    for t in range(len(still) - 2, -1, -1):
        at = begin[: still[t + 1]] + t
        ahead = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        moves += e * ((alpha[at] * own[: still[t + 1], None]).T @ ahead)
        beta[at] = ahead @ e.T
    good = alpha * beta
    log_z = np.add.reduceat(np.log(scale) + shift, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return good[:, 1] / good.sum(axis=1), moves, log_z


def _mean(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1e-3, rate: float = 0.08) -> Field:
    """Maximum conditional likelihood of the lines' labels by Adam, then the logistic curve."""
    if not len(label) or label.min() == label.max():
        prior = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), (0.0, float(_logit(np.array(prior)))))
    lines = np.diff(bounds)
    y = np.repeat(label, lines).astype(float)
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    pair = np.flatnonzero(inner)
    # Both labels weigh alike, and a document as MAX_LINES lines at most.
    weight = np.minimum(lines, MAX_LINES) / lines
    mass = np.array([(weight * lines)[label == k].sum() for k in (0, 1)])
    weight = weight * (mass.sum() / 2 / mass)[label]
    of_line = np.repeat(weight, lines)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pair - 1].astype(int), y[pair].astype(int)), of_line[pair])
    parts = np.concatenate([np.zeros(WIDTH), np.zeros(4)])
    m, v = np.zeros_like(parts), np.zeros_like(parts)
    for i in range(1, rounds + 1):
        good, moves, _ = marginals(features @ parts[:WIDTH], bounds, parts[WIDTH:].reshape(2, 2), weight)
        slope = np.concatenate([features.T @ (of_line * (good - y)), (moves - seen).ravel()]) / of_line.sum() + ridge * parts
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        parts -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weights, steps = parts[:WIDTH].copy(), parts[WIDTH:].reshape(2, 2).copy()
    raw = _logit(_mean(marginals(features @ weights, bounds, steps)[0], size, bounds))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - label) * raw).sum() + 0.1 * (a - 1), (p - label).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Field(weights, steps, (max(float(a), 1e-3), float(b)))


def _curved(raw: np.ndarray, field: Field) -> np.ndarray:
    return 1 / (1 + np.exp(-(field.curve[0] * _logit(raw) + field.curve[1])))


def _line_blocks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A text in blocks of whole lines: bytes, starts and ends, of about ``PART`` bytes and ``LINES`` lines at most."""
    at = 0
    while at <= len(text):
        stop = text.find(b"\n", at + PART) + 1 or len(text) + 1
        data = np.frombuffer(text[at:stop] if stop <= len(text) else text[at:] + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)[:LINES]
        yield data[: ends[-1] + 1], np.concatenate(([0], ends[:-1] + 1)), ends
        at += int(ends[-1]) + 1


def _long_mean(text: bytes, field: Field) -> float:
    """The length-weighted mean of the marginals of a text of very many lines, with some forty bytes a line.

    Features are made block by block and turned into potentials at once. The chain is cut into
    as many parts as each has lines: the parts' step matrices are multiplied side by side,
    which gives what enters each part from either end, and the recursions then go through
    some parts at a time. So it takes steps in the order of the square root of the lines.
    """
    n, at = text.count(b"\n") + 1, 0
    sets, repeated = np.empty(n, np.uint64), np.empty(n, bool)
    for data, starts, _ in _line_blocks(text):
        _, _, count, sets[at : at + len(starts)] = _counts(data, starts)
        repeated[at : at + len(starts)] = count > 0
        at += len(starts)
    order = np.argsort(sets, kind="stable")
    sets = sets[order]
    fresh = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1])))
    repeated[order[fresh]] = False
    del sets, order, fresh
    k, at = len(SHAPE), 0
    parts = [field.weights[i * k : (i + 1) * k] for i in range(3)]
    emit, size = np.full(n, field.weights[3 * k :] @ [np.float32(np.log1p(n) / 6), np.float32(1 / n)]), np.empty(n, np.int32)
    for data, starts, ends in _line_blocks(text):
        h, line, count, _ = _counts(data, starts)
        shape = _shape(data, starts, ends, h, line, count, repeated[at : at + len(starts)]).astype(np.float64)
        size[at : at + len(starts)] = ends - starts + 1
        own, before, after = (shape @ w for w in parts)
        emit[at : at + len(starts)] += own
        # A line's shape counts in the line after it as the one before, and the other way round.
        emit[at + 1 : at + 1 + len(starts)] += before[: n - at - 1]
        emit[max(at - 1, 0) : at - 1 + len(starts)] += after[1 if at == 0 else 0 :]
        at += len(starts)
    del repeated
    length = int(np.ceil(np.sqrt(n)))
    count = -(-n // length)
    e = np.exp(field.steps)
    steps = np.arange(length)

    def local(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of the lines of some parts, and which of them are there."""
        place = (np.arange(first, last) * length)[:, None] + steps
        there = place < n
        value = np.where(there, emit[np.minimum(place, n - 1)], 0.0)
        shift = np.maximum(value, 0)
        return np.stack([np.exp(-shift), np.exp(value - shift)], axis=2), there

    group = max(1, PART // length)
    product = np.empty((count, 2, 2))
    for a in range(0, count, group):
        potential, there = local(a, min(a + group, count))
        now = np.broadcast_to(np.eye(2), (len(potential), 2, 2))
        for t in steps:
            move = e * potential[:, t, None, :]
            if a == 0 and t == 0:
                move[0] = np.diag(potential[0, 0])
            now = np.where(there[:, t, None, None], now @ move, now)
            now = now / now.sum(axis=(1, 2), keepdims=True)
        product[a : a + group] = now
    enter, leave = np.ones((count + 1, 2)), np.ones((count + 1, 2))
    for i in range(count):
        enter[i + 1] = enter[i] @ product[i]
        enter[i + 1] /= enter[i + 1].sum()
    for i in range(count - 1, 0, -1):
        leave[i] = product[i] @ leave[i + 1]
        leave[i] /= leave[i].sum()
    total = 0.0
    for a in range(0, count, group):
        b = min(a + group, count)
        potential, there = local(a, b)
        alpha = np.empty((b - a, length, 2))
        now = enter[a:b]
        for t in steps:
            ahead = now @ e
            if a == 0 and t == 0:
                ahead[0] = 1.0
            now = np.where(there[:, t, None], ahead * potential[:, t], now)
            now = now / now.sum(axis=1, keepdims=True)
            alpha[:, t] = now
        beta = leave[a + 1 : b + 1]
        for t in steps[::-1]:
            good = alpha[:, t] * beta
            at = np.flatnonzero(there[:, t])
            total += float((good[at, 1] / good[at].sum(axis=1) * size[(a + at) * length + t]).sum())
            back = (potential[:, t] * beta) @ e.T
            beta = np.where(there[:, t, None], back / back.sum(axis=1, keepdims=True), beta)
    return total / float(size.sum(dtype=np.int64))


def _pieces(texts: list[bytes | None], lines: list[int]) -> Iterator[slice]:
    """Slices of texts of about ``PART`` bytes and ``LINES`` lines together, one text at least."""
    for part in words.portions(texts, PART):
        begin, held = part.start, 0
        for i in range(part.start, part.stop):
            if i > begin and held + lines[i] > LINES:
                yield slice(begin, i)
                begin, held = i, 0
            held += lines[i]
        yield slice(begin, part.stop)


def score(texts: list[bytes | None], field: Field) -> np.ndarray:
    out = np.empty(len(texts))
    lines = [(t or b"").count(b"\n") + 1 for t in texts]
    for part in _pieces(texts, lines):
        if lines[part.start] > LINES:
            out[part] = _long_mean(texts[part.start], field)
            continue
        features, size, bounds = line_features(texts[part])
        good, _, _ = marginals(features.astype(np.float64) @ field.weights, bounds, field.steps)
        out[part] = _mean(good, size, bounds)
    return _curved(out, field)


def sampled(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, max_documents: int, max_bytes: int, max_lines: int = MAX_SAMPLED_LINES) -> DataFrame:
    """``text``, ``label`` of the sample: labelled rows in the order of hashed ids, within the bounds."""
    named = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    named = named.orderBy(F.xxhash64("_id"), "_id", "label").limit(max_documents)  # rows of two numbers
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(named), "_id")
    order = [F.xxhash64("_id"), F.col("_id"), F.col("label"), F.xxhash64("text")]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = (F.length(plain) - F.length(F.translate(plain, "\n", "")) + 1).alias("lines")
    taken, total, held = set(), 0, 0
    for r in own.select("_id", "label", F.xxhash64("text").alias("print"), size, lines).orderBy(*order[:3], "print").limit(max_documents).collect():  # five numbers a row
        if total + r["size"] <= max_bytes and held + r["lines"] <= max_lines:
            total, held = total + r["size"], held + r["lines"]
            taken.add((r["_id"], r["label"], r["print"]))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(sorted(taken), f"_id {own.schema['_id'].dataType.simpleString()}, label int, print long")
    return own.withColumn("print", F.xxhash64("text")).join(F.broadcast(chosen), ["_id", "label", "print"]).dropDuplicates(["_id", "label", "print"]).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", doc_id: str = "doc_id", max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES, max_lines: int = MAX_SAMPLED_LINES) -> Field:
    """Fit on the sample that the bounds allow; the features are made in Spark's tasks."""
    sample = sampled(docs, labels, text, label, doc_id, max_documents, max_bytes, max_lines)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                texts, labels = (batch.column(c).slice(i, STEP).to_pylist() for c in (0, 1))
                for part in words.portions(texts):
                    features, size, bounds = line_features(texts[part])
                    n = np.diff(bounds)
                    cols = [pa.array([features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array([size[a:b].astype("<i8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array(n), pa.array(labels[part], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["features", "size", "lines", "label"])

    got = sample.mapInArrow(tidy(make), "features binary, size binary, lines long, label int").collect()  # of the sample, so within its bounds
    got.sort(key=lambda r: (r["label"], bytes(r["features"])))
    features = np.frombuffer(b"".join(bytes(r["features"]) for r in got), np.float32).reshape(-1, WIDTH)
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in got), "<i8")
    bounds = np.concatenate(([0], np.cumsum([r["lines"] for r in got]))).astype(np.int64)
    return fit(features.astype(np.float64), size, bounds, np.array([r["label"] for r in got]))


def scored(df: DataFrame, field: Field, text: str = "text", out: str = "score") -> DataFrame:
    """All rows with the score of their whole text; a column named ``out`` is replaced."""

    def of(texts: pa.Array) -> pa.Array:
        found = [score(texts.slice(i, STEP).to_pylist(), field) for i in range(0, len(texts), STEP)]
        release()
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return df.withColumn(out, arrow_udf(of, "double")(F.col(text).cast("binary")))
