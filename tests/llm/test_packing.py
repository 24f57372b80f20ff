from collections import defaultdict

import numpy as np

from feescope.llm import packing


def brute(sizes, clusters, sources, capacity, most):
    bins = []  # residual, clusters, sources
    out = []
    for size, c, s in zip(sizes, clusters, sources):
        fits = [
            (b[0], i) for i, b in enumerate(bins) if b[0] >= size and c not in b[1] and len(b[2] | {s}) <= most
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(c)
        bins[i][2].add(s)
        out.append(i)
    return out


def test_is_best_fit():
    rng = np.random.default_rng(4)
    for n_clusters, n_sources in ((500, 3), (5, 9), (1, 1)):
        sizes = sorted(rng.integers(0, 101, 400).tolist(), reverse=True)
        args = sizes, rng.integers(0, n_clusters, 400).tolist(), rng.integers(0, n_sources, 400).tolist(), 100, 2
        assert packing.best_fit(*args) == brute(*args)


def test_every_word_once_and_no_conflict(docs):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 300)) + str(i), f"s{i % 11}") for i in range(2000)]
    rows += [(5000 + i, "copy " * 50, "hot") for i in range(1000)]
    rows += [(7000, "long " * 7000, None), (7001, None, "s1"), (7002, "", "s1"), (None, "a b", "s1"), (None, "a b", "s1")]
    found = packing.pack(docs(rows), capacity=1024, block_items=700).collect()
    words = defaultdict(list)
    bins = defaultdict(list)
    for r in found:
        words[r.doc_id].append((r.offset, r.size))
        bins[r.bin].append(r)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            spans = sorted(words[doc_id])
            assert [o for o, _ in spans] == [1024 * i for i in range(len(spans))]
            assert sum(s for _, s in spans) == len((text or "").split())
    assert len(words[None]) == 2 and len(words) == len({r[0] for r in rows})
    for own in bins.values():
        assert sum(r.size for r in own) == own[0].bin_size <= 1024
        assert len({r.cluster for r in own}) == len(own) and len({r.source for r in own}) <= 4
    loose = [own for own in bins.values() if not any(r.source == "hot" for r in own)]
    assert sum(o[0].bin_size for o in loose) / (1024 * len(loose)) > 0.9


def test_empty(docs):
    assert packing.pack(docs([])).count() == 0
