"""Very long texts give what the plain recursions give, in bounded memory and time."""

import random
import subprocess
import sys

import numpy as np
import pytest

from lumenlit.llm import hmm, quality


def model(states=8, symbols=300, seed=0):
    r = np.random.default_rng(seed)
    return hmm.Model(r.dirichlet(np.ones(states)), r.dirichlet(np.ones(states), states), r.dirichlet(np.ones(symbols), states).T.copy())


@pytest.mark.parametrize(("long", "side"), [(1, 1 << 19), (1, 1), (4, 30), (50, 100)])
def test_parts_of_a_text_give_the_same_counts(monkeypatch, long, side):
    m, r = model(), np.random.default_rng(1)
    lengths = [1, 2, 3, 40, 700, 5, 1999]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    symbol = r.integers(0, 300, bounds[-1])
    plain, counts = hmm.forward(m, symbol, bounds), hmm.expected(m, symbol, bounds)
    monkeypatch.setattr(hmm, "LONG", long)
    monkeypatch.setattr(hmm, "SIDE", side)
    assert np.allclose(hmm.forward(m, symbol, bounds), plain, rtol=1e-12)
    for x, y in zip(hmm.expected(m, symbol, bounds), counts, strict=True):
        assert np.allclose(x, y, rtol=1e-9, atol=1e-12)


def test_words_of_a_text_taken_apart(monkeypatch):
    text = ("Ab c " * 100 + "x" * 137 + "\n é " + "wörd. " * 50).encode()
    whole = hmm.tokens([text])[0]
    monkeypatch.setattr(hmm, "BLOCK", 40)
    assert (hmm.tokens([text])[0] == whole).all() and len(whole) == len(text.split())


def test_lines_in_parts_score_the_same(monkeypatch):
    r, n = random.Random(3), np.random.default_rng(3)
    field = quality.Field(n.normal(size=quality.WIDTH), n.normal(size=(2, 2)), (0.7, 0.1))
    say = lambda k: "\n".join(" ".join(r.choice(("a", "Bc!", "d.", "|", "9", "é")) for _ in range(r.choice((0, 0, 1, 3, 8)))) for _ in range(k)).encode()
    texts = [*(say(r.choice((1, 2, 5, 40, 300))) for _ in range(40)), b"", None, b"\n", b"x" * 5000]
    plain = quality.score(texts, field)
    for part, lines in ((1 << 20, 1), (50, 1), (7, 3), (200, 10)):
        monkeypatch.setattr(quality, "PART", part)
        monkeypatch.setattr(quality, "LINES", lines)
        assert np.allclose(quality.score(texts, field), plain, rtol=1e-12)


MEMORY = """
import resource, sys, time
import numpy as np
from lumenlit.llm import hmm, quality
from tests.llm.test_long_texts import model
began = time.time()
{work}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000, time.time() - began)
"""


@pytest.mark.parametrize(
    "work",
    [
        "quality.score([b'\\n' * 10_000_000], quality.Field(np.ones(quality.WIDTH), np.zeros((2, 2)), (1.0, 0.0)))",
        "key, bounds = hmm.tokens([b'word ' * 10_000_000]); s = (key % np.uint64(300)).astype(np.int64); del key; hmm.forward(model(), s, bounds); hmm.expected(model(), s, bounds)",
    ],
)
def test_ten_million_lines_or_words_take_less_than_half_a_gigabyte(work):
    done = subprocess.run([sys.executable, "-c", MEMORY.format(work=work)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout.split()[0]) < 500
