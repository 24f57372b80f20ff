import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feescope.llm import mixing


def brute_targets(sizes, weights, share, most):
    out, fixed = [0.0] * len(sizes), set()
    while True:
        rest = share * sum(sizes) - sum(out[i] for i in fixed)
        total = sum(w for i, w in enumerate(weights) if i not in fixed)
        for i, w in enumerate(weights):
            if i not in fixed:
                out[i] = rest * w / total
        over = [i for i in range(len(sizes)) if i not in fixed and out[i] > most * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = most * sizes[i]
            fixed.add(i)


def test_targets():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 20):
        sizes = rng.integers(0, 1000, n).tolist()
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights, 1.5, 2.0)
        assert got == pytest.approx(brute_targets(sizes, weights, 1.5, 2.0))
        assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_tree_keeps_quotas():
    quotas = np.array([50, 3, 0, 700, 1])
    split = mixing.split_quotas(quotas, 7, np.random.default_rng(1))
    assert (split.sum(0) == quotas).all() and split.min() >= 0
    assert split.sum(1).max() - split.sum(1).min() <= 1


def test_mix(docs):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 400)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    rows += [(9001, None, "s1"), (9002, "a b", None), (9003, "\x0ba\x1fb c", None), (None, "x y z", "s2"), (None, "x y z", "s2")]
    given = docs(rows)
    found = mixing.mix(given).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted(
        (str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows
    )
    sizes, taken, goal = Counter(), Counter(), {}
    shards = defaultdict(Counter)
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.places)
        for p in r.places:
            assert 0 <= p.shard < 16
            shards[r.source][p.shard] += p.words
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    expected = brute_targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.5, 2.0)
    for s, t in zip(order, expected):
        assert goal[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
        assert all(r.source_size == sizes[s] for r in found if r.source == s)
    assert len(shards["hot"]) > 4  # 14 blocks
    again = mixing.mix(given.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty_and_wordless(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [(r.size, r.taken, r.target) for r in mixing.mix(docs([(1, " ")])).collect()] == [(0, 0, 0.0)]
