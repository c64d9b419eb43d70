"""The trainer, the calibration and the weights of operator 5 against plain versions, one coordinate at a time."""

import math
from collections import Counter

import numpy as np
import pytest

from voltledger.llm import language_id as li


def plain_ftrl(x, y, classes, dims, epochs, alpha, beta, l1, l2):
    z, n = [[0.0] * classes for _ in range(dims)], [[0.0] * classes for _ in range(dims)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(y)).tolist():
            at, v = x[k]
            w = {(i, c): weight(i, c) for i in at.tolist() for c in range(classes)}
            score = [sum(a * w[i, c] for i, a in zip(at.tolist(), v.tolist(), strict=True)) for c in range(classes)]
            total = sum(math.exp(s - max(score)) for s in score)
            p = [math.exp(s - max(score)) / total for s in score]
            for i, a in zip(at.tolist(), v.tolist(), strict=True):
                for c in range(classes):
                    g = a * (p[c] - (c == y[k]))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(dims)])


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.3, 0.1)])
def test_ftrl_steps_equal_the_plain_ones(l1, l2):
    rng = np.random.default_rng(2)
    x = [(np.sort(rng.choice(20, 6, replace=False)), rng.random(6)) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    got = li.train_ftrl(x, y, 3, 20, 4, 0.5, 1.0, l1, l2)
    assert np.allclose(got, plain_ftrl(x, y, 3, 20, 4, 0.5, 1.0, l1, l2), atol=1e-12)
    assert (got == 0).any() == (l1 > 0)  # the L1 penalty leaves exact zeros


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(3)
    scores, y = rng.normal(0, 4, (200, 4)), rng.integers(0, 4, 200)
    scores[np.arange(200), y] += 2

    def loss(t):
        return -sum(s[k] / t - math.log(sum(math.exp(v / t) for v in s)) for s, k in zip(scores.tolist(), y.tolist(), strict=True))

    grid = [2.0 ** (-5 + i / 8) for i in range(81)]
    assert math.isclose(li.temperature(scores, y), min(grid, key=loss)) and li.temperature(scores[:0], y[:0]) == 1.0


def test_grams_are_those_of_the_text():
    texts = ["Abc é", "", "x", "aaaa", "日本 日"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    found = li.grams(np.frombuffer(b"".join(raw), np.uint8), offsets, 18)
    for text, (have, count) in zip(texts, found, strict=True):
        plain = Counter(text.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
        assert sorted(count.tolist()) == sorted(plain.values()) and len(set(have.tolist())) == len(plain)
        _, v = li._weighted(have, count, np.full(1 << 18, 2.0))
        assert not len(v) or math.isclose((v * v).sum(), 1)
