import zlib
from collections import Counter, defaultdict

from feescope.llm import sharding


def check(rows, found, n_shards=8, share=0.05):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / n_shards
    assert len(sizes) == n_shards and all(abs(s - mean) <= share * mean for s in sizes.values()), sizes


def test_hot_group_and_long_text(docs):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(4000)]
    rows += [(10_000 + i, "one text that a third of all rows share " * 10) for i in range(2000)]
    rows += [(i, "x" * 40_000) for i in (20_000, 20_001)]
    found = sharding.shard_by_bytes(docs(rows)).collect()
    check(rows, found)
    assert len({r.shard for r in found if 10_000 <= r.doc_id < 20_000}) > 1


def test_small_groups_stay_whole(docs):
    rows = [(i, f"group {i // 3} " + "y" * (i // 3 % 50)) for i in range(6000)]
    found = sharding.shard_by_bytes(docs(rows)).collect()
    check(rows, found)
    shards = defaultdict(set)
    for r in found:
        shards[r.doc_id // 3].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_nulls_repeats_and_empty(docs):
    rows = [(None, None)] * 40 + [(1, "a")] * 40 + [(2, ""), (3, "é")] * 40
    found = sharding.shard_by_bytes(docs(rows)).collect()
    check(rows, found, share=0.2)
    assert sharding.shard_by_bytes(docs([])).count() == 0


def test_plan_runs_no_python(docs):
    plan = sharding.shard_by_bytes(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_overfull_range_is_cut(docs):
    rows = sharding._slim(docs([(i, "same") for i in range(3000)]))
    cuts, totals = sharding.splitters(rows, 16)
    assert max(b for b, _ in totals.values()) <= 3 * sum(b for b, _ in totals.values()) / 16


def hot_nulls():
    """A third of all rows without text, next to texts of about 1,000 bytes."""
    return [(i, None if i % 2 else "") for i in range(2000)] + [(10_000 + i, f"text {i} " * 110) for i in range(4000)]


def test_null_texts_are_cut_by_rows(docs):
    rows = sharding._slim(docs(hot_nulls()))
    cuts, totals = sharding.splitters(rows, 64)
    assert max(n for _, n in totals.values()) <= 3 * 6000 / 64
    assert max(b for b, _ in totals.values()) <= 3 * sum(b for b, _ in totals.values()) / 64


def test_group_over_several_ranges_stays_whole(docs):
    """Null texts weigh far below 1 % of a shard but fill many ranges."""
    rows = hot_nulls()
    found = sharding.shard_by_bytes(docs(rows)).collect()
    check(rows, found)
    assert len({r.shard for r in found if r.doc_id < 10_000}) == 1
