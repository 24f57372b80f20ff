import hashlib
import re

from feescope.llm import exact_dedup

ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b"), (7, "Ab"), (None, "a  b  "), (9, "x" * 300_000),
    (10, "x" * 300_000), (10, "x" * 300_000), (11, "ñ"), (12, "a b"),
]


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text), doc_id is None, doc_id))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members), m == best, key) for m in members]
    return sorted(out, key=str)


def test_groups_match_brute_force(docs):
    rows = ROWS + [(100 + i, "same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(300)]
    found = exact_dedup.duplicate_groups(docs(rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_a_full_field_only_costs_shuffle(docs):
    rows = ROWS + [(1000 + i, f"text {i % 400}") for i in range(600)]
    found = exact_dedup.duplicate_groups(docs(rows), max_bits=1 << 16).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_keep_one_returns_whole_rows(docs):
    given = docs(ROWS)
    kept = exact_dedup.keep_one(given)
    assert kept.columns == given.columns
    # (10, x) twice loses to (9, x); of "a b" copies the null id has most code points
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "6", "7", "9", "11", "12"])


def test_rows_equal_in_all_are_one(docs):
    assert exact_dedup.keep_one(docs([(1, "a")] * 5)).count() == 1


def test_empty(docs):
    assert exact_dedup.duplicate_groups(docs([])).count() == 0
    assert exact_dedup.keep_one(docs([])).count() == 0
