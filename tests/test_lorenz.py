from __future__ import annotations

from decimal import Decimal as D

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from feescope.operators import lorenz, marts
from feescope.operators.quality import content_hash

SCHEMA = "id string, v decimal(18,2)"


def frame(spark, values):
    rows = [(f"{i:05d}", None if v is None else D(v).quantize(D("0.01"))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def by_global_window(df):
    """The plain definition: one window over all rows."""
    rows, peers = Window.orderBy("v", "id"), Window.orderBy("v")
    return df.select(
        "*",
        F.row_number().over(rows).cast("bigint").alias("rn"),
        F.coalesce(F.sum("v").over(peers), F.lit(0)).cast("decimal(28,2)").alias("cum_value"),
    )


def assert_same(df, n_buckets):
    got = lorenz.running_totals(df, "v", ["id"], n_buckets).select("id", "v", "rn", "cum_value")
    want = by_global_window(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("n_buckets", [1, 3, 8, None])
def test_equals_the_global_window(spark, n_buckets):
    assert_same(frame(spark, [(i * 37) % 23 for i in range(300)]), n_buckets)


def test_one_value_with_most_rows_spans_many_buckets(spark):
    df = frame(spark, [5] * 400 + list(range(10)) + [7] * 90)
    placed, n = lorenz.bucketed(df, ["v", "id"], 8)
    assert n == 8
    assert placed.filter("v = 5").select("_bucket").distinct().count() > 3
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert max(sizes) < 250
    assert_same(df, 8)


def test_tags_rise_with_the_ordering_and_agree_between_runs(spark):
    df = frame(spark, [(i * 7919) % 101 if i % 9 else None for i in range(3000)])
    for n in (2, 7, 40):
        placed, _ = lorenz.bucketed(df, ["v", "id"], n)
        rows = placed.orderBy("v", "id").select("_bucket", "id").collect()
        tags = [r._bucket for r in rows]
        assert tags == sorted(tags) and set(tags) == set(range(n))
        assert max(tags.count(k) for k in range(n)) < 3 * 3000 / n
        again, _ = lorenz.bucketed(df.repartition(5), ["v", "id"], n)
        assert [(r._bucket, r.id) for r in again.orderBy("v", "id").collect()] == [(r._bucket, r.id) for r in rows]


def test_building_the_frame_writes_nothing(spark):
    """One query picks the bounds; nothing else runs until the frame is used, and no row of it is kept."""
    df = frame(spark, list(range(100)))
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    got = lorenz.running_totals(df.filter("v >= 0"), "v", ["id"], 4)
    assert executions.executionsCount() - before == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == plan.count("LogicalRDD [id") and "Checkpoint" not in plan


def test_all_equal_and_missing_values(spark):
    assert_same(frame(spark, [3] * 100), 4)
    assert_same(frame(spark, [None, 1, None, 2, 2, 1]), 3)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.integers(1, 6))
def test_running_totals_property(spark, values, n_buckets):
    assert_same(frame(spark, values), n_buckets)


def test_empty_input(spark):
    assert lorenz.running_totals(frame(spark, []), "v", ["id"], 4).count() == 0
    shares = lorenz.lorenz(frame(spark, []), "v", ["id"])
    assert shares.count() == 0
    row = lorenz.gini(shares).first()
    assert row.gini is None and row.n_points == 0


def test_ties_share_the_peer_total(spark):
    got = lorenz.running_totals(frame(spark, [1, 2, 2, 3]), "v", ["id"], 2).orderBy("rn").collect()
    assert [r.cum_value for r in got] == [D(1), D(5), D(5), D(8)]
    assert {(r.n_rows, r.sum_value) for r in got} == {(4, D(8))}


def test_shares_of_zero_are_unknown(spark):
    rows = lorenz.lorenz(frame(spark, [0, 0]), "v", ["id"]).collect()
    assert {r.cum_share_drug for r in rows} == {None}
    assert sorted(r.cum_share_providers for r in rows) == [D("0.5"), D(1)]


def trapezoid(points, start=None):
    points = ([start] if start else []) + points
    return sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5], [1] * 8, [1, 1, 1, 97], [4], [2, 2, 5, 5, 5, 9]])
def test_gini_equals_the_row_wise_area(spark, values):
    mart = lorenz.lorenz(frame(spark, values), "v", ["id"])
    points = sorted((float(r.cum_share_providers), float(r.cum_share_drug)) for r in mart.collect())
    assert float(lorenz.gini(mart).first().gini) == pytest.approx(1 - 2 * trapezoid(points), abs=3e-6)
    whole = 1 - 2 * trapezoid(points, (0.0, 0.0))
    assert float(lorenz.gini(mart, from_origin=True).first().gini) == pytest.approx(whole, abs=3e-6)


def test_mart_on_rows(fact_of):
    drug = {"HCPCS_Cd": "J1", "HCPCS_Drug_Ind": "Y"}
    fact = fact_of(
        drug | {"Rndrng_NPI": "1", "Tot_Srvcs": "1"},
        drug | {"Rndrng_NPI": "2", "Tot_Srvcs": "3"},
        drug | {"Rndrng_NPI": "2", "Rndrng_Prvdr_State_Abrvtn": "BX", "Tot_Srvcs": "4"},
        {"Rndrng_NPI": "3"},
    )
    mart = marts.jcode_concentration(fact)
    rows = mart.orderBy("cum_share_providers").collect()
    # One provider in two states has two points; one without drugs has none.
    assert [(r.npi, r.state_abrvtn) for r in rows] == [("1", "AX"), ("2", "AX"), ("2", "BX")]
    assert [r.cum_share_drug for r in rows] == [D("0.125000"), D("0.500000"), D("1.000000")]
    again = marts.jcode_concentration(fact, n_buckets=3)
    assert content_hash(mart).first() == content_hash(again).first()


def test_curve_is_sorted(spark):
    mart = lorenz.lorenz(frame(spark, [5, 1, 3]), "v", ["id"])
    xs = [r.cum_share_providers for r in lorenz.lorenz_curve(mart).collect()]
    assert xs == sorted(xs)
