import hashlib
from collections import Counter

import numpy as np
import pytest

from feescope.llm import suffix_dedup


def brute(rows, n):
    seen = Counter(t[i : i + n] for t in map(raw, rows) for i in range(len(t) - n + 1))
    out = []
    for row in rows:
        t = raw(row)
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(t) else 0
        out.append((row[0], len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def raw(row):
    return (row[1] or "").encode()


def corpus(rng, n_docs, alphabet, n):
    def text(size):
        return "".join(rng.choice(list(alphabet), size))

    shared = [text(int(n * f)) for f in (0.9, 1, 1.02, 1.3, 2, 4)]
    rows = []
    for i in range(n_docs):
        parts = [text(int(rng.integers(0, 2 * n)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[rng.integers(6)], text(int(rng.integers(0, n)))]
        rows.append((i, "".join(parts)))
    copy = rows[3][1]
    changed = list(rows[4][1])
    if len(changed) > 3:
        changed[len(changed) // 2] = "#"
    return rows + [(900, copy), (901, "".join(changed)), (902, "ab" * n), (903, "a" * (3 * n)), (None, shared[5]), (904, None), (905, "é" * n)]


@pytest.mark.parametrize("n, gram, alphabet, wide", [(200, 32, "abcdefgh ", 50_000), (24, 8, "ab ", 50_000), (24, 8, "abcd", 3), (40, 16, "ab", 1)])
def test_matches_brute_force(docs, n, gram, alphabet, wide):
    rows = corpus(np.random.default_rng(n + wide), 60, alphabet, n)
    found = suffix_dedup.remove_repeats(docs(rows), n, gram, wide).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, n)


def test_long_text_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    rng = np.random.default_rng(9)
    rows = corpus(rng, 12, "abcdef", 60)
    rows.append((77, "".join(t or "" for _, t in rows[:12])))
    texts = [raw(r) for r in rows]
    total = sum(max(0, len(t) - 59) for t in texts)
    found = [x for x in suffix_dedup.stretches(texts, 60, 16)]
    assert sum(int((x[4] - x[3] - 59).sum()) for x in found) == total
    for owner, buffer, _, start, end, place, offset in found:
        for i, a, b, p, o in zip(owner, start, end, place, offset):
            assert texts[i][a - o : b - o] == buffer[a:b] and a <= p <= b - 16


def test_a_passage_in_a_third_of_all_rows(docs):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(word() for _ in range(30))) for i in range(600)]
    found = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    expected = {r[0]: r[2] for r in brute(rows, 200)}
    assert found == expected and min(v for k, v in found.items() if k % 3 == 0) >= len(passage)


def test_repeats_are_groups_with_all_occurrences():
    bodies = [b"xxLEFTanchorRIGHTyy", b"zzLEFTanchorRIGHTww", b"zzLEFTanchorRIG", b"qanchorRIGHT"]
    places = [b.index(b"anchor") for b in bodies]
    found = suffix_dedup.repeats(bodies, places, 12)
    assert (4, 11, [0, 1], True) in [(a, b, sorted(m), x) for a, b, m, x in found]
    assert any(sorted(m) == [0, 1, 2] and a == 4 and b == 9 for a, b, m, _ in found)


def test_empty(docs):
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
