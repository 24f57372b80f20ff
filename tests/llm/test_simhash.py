import math
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from feescope.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_matches_brute_force(docs):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 6))) for _ in range(150)]
    base = [f"w{x}" for x in rng.integers(0, 500, 400)]
    for _ in range(60):
        other = list(base)
        other[rng.integers(0, 400)] = "NEW"
        texts.append(" ".join(other))
    texts += [None, "", " \n", "A b C", "a B c", "é É", "long " * 50_000]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in simhash.simhash_components(docs(rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in found.values())
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints)
    assert len({r.component_id for r in found.values()}) < len(set(prints.values()))


@pytest.mark.parametrize("limit, lanes, n", [(2, 1, 1500), (12, 1, 700), (40, 4, 700)])
def test_pruned_search_equals_all_pairs(limit, lanes, n):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (8, lanes), dtype=np.uint64)
    words = base[rng.integers(0, 8, n)]
    for _ in range(limit // 2 + 1):
        words[np.arange(n), rng.integers(0, lanes, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    words = words[np.lexsort([simhash.gray_rank(words[:, i]) for i in range(lanes)])]
    pairs = {(int(i), int(j)) for a, b in simhash.near_pairs(words, limit) for i, j in zip(a, b)}
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(-1) <= limit
    assert pairs == {(i, j) for i, j in np.argwhere(near).tolist() if i > j}


def test_exact_masks_leave_bounded_nodes():
    masks = simhash.exact_masks(2)
    assert len(masks) == 28 and {int(m[0]).bit_count() for m in masks} == {48}


def test_null_and_repeated_ids_and_empty_table(docs):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (3, None)]
    found = simhash.simhash_components(docs(rows))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found.collect()) == [
        ("3", "3"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None"),
    ]
    assert simhash.simhash_components(docs([])).count() == 0


@pytest.mark.parametrize("n_nodes", [10**4, 10**6])
def test_masks_hold_the_recall_for_pairs_of_any_distance(n_nodes):
    """Simulated fingerprints of pairs exactly at 0.8, whose differing bits spread around the mean."""
    lanes, share = 4, math.acos(1.6 / 1.8) / math.pi
    masks = np.unpackbits(np.stack(simhash.similarity_masks(n_nodes, 0.8, lanes)).view(np.uint8), axis=1).astype(np.float32)
    differ = (np.random.default_rng(5).random((20_000, 64 * lanes)) < share).astype(np.float32)
    met = (differ @ masks.T == 0).any(1) & (differ.sum(1) <= simhash._limit(0.8, lanes))
    assert met.mean() > 0.97
    assert 0.98 <= simhash.chance_met(len(masks), int(masks[0].sum()), 0.8, lanes) < 0.985


def _flip(rng, words, most):
    out = words.copy()
    for row in out:
        for bit in rng.choice(256, rng.integers(0, most + 1), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    return out


def _mixture(rng, n_copies, n_others, most):
    base = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    words = np.r_[_flip(rng, np.repeat(base, n_copies, 0), most), rng.integers(0, 1 << 63, (n_others, 4), dtype=np.uint64)]
    return words[rng.permutation(len(words))]


def _near(words, limit):
    gap = np.bitwise_count(words[:, None] ^ words[None]).sum(-1)
    return {(i, j) for i, j in zip(*np.nonzero(gap <= limit)) if i != j}


@pytest.mark.parametrize("n_copies, n_others, most", [(0, 40, 0), (60, 40, 10), (300, 100, 40), (2, 100, 3)])
def test_loose_links_are_true_and_reach_every_row_with_a_candidate(n_copies, n_others, most):
    words, limit = _mixture(np.random.default_rng(n_copies), n_copies, n_others, most), 60
    near = _near(words, limit)
    i, j = simhash.star_links(words, limit)
    assert set(zip(i.tolist(), j.tolist())) <= near
    assert {*i.tolist(), *j.tolist()} == {i for i, _ in near}
    assert len(i) <= len(words)


@pytest.mark.parametrize("sizes", [[400], [150, 120, 60, 20], [1] * 120, [90, *[1] * 200], [2] * 80])
def test_unlike_pairs_are_all_pairs_across_labels(sizes):
    rng = np.random.default_rng(len(sizes))
    words = _mixture(rng, sum(sizes), 0, 45)
    label, limit = rng.permutation(np.repeat(np.arange(len(sizes)), sizes)), 60
    found = [(i, j) for a, b in simhash.unlike_pairs(words, label, limit) for i, j in zip(a.tolist(), b.tolist())]
    wanted = {(i, j) for i, j in _near(words, limit) if i < j and label[i] != label[j]}
    assert len(found) == len(wanted) and {(min(p), max(p)) for p in found} == wanted


def test_streamed_nodes_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 33, 120, 1, 1, 31, 32, 64, 2, 300, 1]
    words = np.concatenate([_flip(rng, np.repeat(rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64), n, 0), 30) for n in sizes])
    key, node, n = np.repeat(np.arange(len(sizes)), sizes), np.arange(sum(sizes)), sum(sizes)
    columns = [np.zeros(n, np.int32), key, node, pa.array([w.astype(">u8").tobytes() for w in words], pa.binary())]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mask", "key", "node", "bits"])
    seen = []
    for width in (n, 1, 7, 100):
        cut = [whole.slice(at, width) for at in range(0, n, width)]
        out = [b for b in simhash._loosely_linked(60)(iter(cut))]
        seen.append(sorted((a, b) for o in out for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist())))
    assert seen[0] and all(s == seen[0] for s in seen)
    assert all(key[a] == key[b] for a, b in seen[0])


def test_a_large_node_takes_time_in_proportion():
    words = _mixture(np.random.default_rng(8), 20_000, 200, 20)
    started = time.monotonic()
    i, _ = simhash.star_links(words, 70)
    assert 19_999 <= len(i) <= 20_200
    for _ in simhash.unlike_pairs(words, np.r_[np.zeros(20_150, int), np.arange(1, 51)], 70):
        pass
    assert time.monotonic() - started < 20
