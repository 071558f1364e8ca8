"""The interval of a claim's trust against a plain loop."""

import hashlib
import random

import pytest

from plumbline.operators import trust


def plain(values, keys, draws):
    post = lambda xs: sum(x * x for x in xs) / sum(xs) if sum(xs) > 0 else 0.0
    if len(values) < 2:
        return (post(values),) * 2
    rng = random.Random(int(hashlib.md5("".join(sorted(keys)).encode()).hexdigest(), 16) % 2**32)
    runs = sorted(post([rng.choice(values) for _ in values]) for _ in range(draws))
    return runs[int(0.025 * draws)], runs[int(0.975 * draws)]


def test_same_draws_without_a_loop(monkeypatch):
    rng = random.Random(5)
    cases = [[rng.choice([0.0, 0.1, 0.35, round(rng.random(), 2), rng.random()]) for _ in range(n)] for n in (0, 1, 2, 2, 3, 4, 5, 7, 8, 9, 16, 30) for _ in range(20)]
    given = [(c, [f"k{i}-{j}" for j in range(len(c))]) for i, c in enumerate(cases)]
    want = [plain(c, k, 200) for c, k in given]
    monkeypatch.setattr(random.Random, "choice", lambda *a: pytest.fail("a draw by itself"))
    assert [trust._interval(c, k, 200) for c, k in given] == want
