"""Words of UTF-8 bytes, found and hashed without a Python object for each word."""

from __future__ import annotations

import numpy as np

#: White space as ``WORD`` in common.py has it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed in one step; a longer single word takes a longer step.
STEP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; bytes 0-8, 14-31 and over 32 belong to words."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        first = start[i]
        j = max(i + 1, int(np.searchsorted(end, first + STEP, "right")))
        part = data[first : end[j - 1]].astype(np.uint64)
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = start[i:j] - first, end[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out ^ (end - start).astype(np.uint64))


def buffer(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts parted by a newline, and where each begins (one more at the end)."""
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(x for t in texts for x in (t or b"", b"\n")), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def portions(texts: list, most: int = 2 << 20):
    """Slices of a list whose texts have about ``most`` bytes together, one text at least."""
    at = 0
    while at < len(texts):
        begin, size = at, 0
        while at < len(texts) and (at == begin or size + len(texts[at] or b"") <= most):
            size += len(texts[at] or b"")
            at += 1
        yield slice(begin, at)
