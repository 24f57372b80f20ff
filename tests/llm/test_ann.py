import numpy as np
import pytest

from feescope.llm import ann


def brute(rows, k, every):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for q, x in rows:
        if q % every == 0:
            scores = [(-float(np.float32(x).astype(float) @ np.float32(y).astype(float)), i) for i, y in rows if i != q]
            out[q] = sorted(scores)[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, entry string").repartition(3)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    same = rng.normal(size=8).tolist()
    rows += [(1000 + i, same) for i in range(150)]  # a third of all rows
    rows += [(2000, None), (2005, []), (2010, [0.0] * 8), (2015, [1.0] * 7 + [None]), (2020, [float("nan")] * 8), (2025, [1.0] * 3), (2030, [float("inf")] * 8)]
    rows += [(None, rng.normal(size=8).tolist()), (5, rows[5][1]), (5, rows[5][1])]
    found = {}
    for r in ann.search(table(spark, rows), every=5, k=10, target=1.0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    expected = brute(rows, 10, 5)
    assert set(found) == set(expected)
    hits = total = 0
    for q, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in expected[q]})
        total += 10
    assert hits / total >= 0.97
    hot = [i for _, i, _ in sorted(found[1000])]
    norm = float(np.float32(same).astype(float) @ np.float32(same).astype(float))
    if expected[1000][0][0] == pytest.approx(-norm):
        assert hot[:9] == [i for _, i in expected[1000]][:9]


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    local = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows.collect()]
    ids, matrix = np.array([i for i, _ in local]), np.stack([v for _, v in local])
    found = {}
    for r in ann.search(rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = matrix @ matrix[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits, total = hits + len(found[q] & set(best)), total + 20
    assert hits / total >= 0.9


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]

    def found():
        hits = ann.search(table(spark, rows), every=2, k=5, target=1.0).collect()
        return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in hits)

    whole = found()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    monkeypatch.setattr(ann, "SEGMENT", 128)
    assert found() == whole


def test_few_and_none(spark):
    assert ann.search(table(spark, [])).count() == 0
    assert ann.search(table(spark, [(0, [1.0, 2.0])])).count() == 0
    found = ann.search(table(spark, [(0, [1.0, 2.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 2, 6.0), (0, 2, 1, 2.0)]
