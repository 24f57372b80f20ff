"""Shapes of physical plans that matter at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feescope.operators import dims, lorenz, marts, quality, serving
from feescope.sources import read_table, table_path, write_table


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Silver, fact and dimensions of sf0.001 on disk."""
    import __spark_entry__ as entry
    from feescope.plans.pipeline import Pipeline, Settings

    root = str(tmp_path_factory.mktemp("lake"))
    job = Pipeline(spark, root, Settings(row_band=(1, 10**6), geo_band=(1, 65)))
    job.run(entry.Tables(spark, entry.SMOKE_DIR).raw)
    return job


def plan_of(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def initial_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(spark, df) -> list[str]:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode).splitlines()


def scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line]


def silver(lake):
    from feescope.schemas import SILVER

    return lake.table(SILVER)


def fact(lake):
    return lake.table("fact_provider_service")


def test_silver_is_one_stage(spark):
    import __spark_entry__ as entry
    from feescope.operators.silver import build_silver
    from feescope.schemas import RAW_SCHEMA

    plan = initial_plan(build_silver(spark.createDataFrame([], RAW_SCHEMA)))
    assert "Exchange" not in plan and "Python" not in plan
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize(
    "build", [dims.build_dim_provider, dims.build_dim_hcpcs, dims.build_dim_geography]
)
def test_texts_stay_out_of_the_distinct_exchange(lake, build):
    """The aggregation that counts distinct values shuffles numbers only, by hash."""
    plan = initial_plan(build(silver(lake)))
    distinct = [line for line in plan.splitlines() if "count(distinct" in line]
    assert distinct and all("HashAggregate" in line for line in distinct)
    assert not any("Sort" in line.split("(")[0] for line in distinct)


def test_fact_scans_read_only_needed_columns(spark, lake):
    (scan,) = scans(plan_of(marts.site_grain(fact(lake))))
    for unused in ("service_sk", "Geo_Premium", "specialty", "Avg_Sbmtd_Chrg"):
        assert unused not in scan
    df = marts.tier_markup(fact(lake), with_providers=False)
    pushed = next(line for line in formatted(spark, df) if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(Tot_Srvcs,25)" in pushed and "IsNotNull(Markup_Ratio)" in pushed


def test_state_filter_prunes_partitions(spark, lake):
    df = serving.apply_filters(fact(lake), states=["AX", "BX"], specialties=["Specialty 1"])
    plan = formatted(spark, df)
    partitions = next(line for line in plan if line.startswith("PartitionFilters"))
    assert "state_abrvtn" in partitions and "IN (AX,BX)" in partitions
    pushed = next(line for line in plan if line.startswith("PushedFilters"))
    assert "EqualTo(specialty,Specialty 1)" in pushed or "In(specialty" in pushed


def test_basket_is_broadcast_and_never_collected(lake):
    plan = plan_of(marts.geo_arbitrage(fact(lake)))
    assert "LeftSemi, BuildRight" in plan and "TakeOrderedAndProject(limit=50" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    "build", [dims.build_dim_provider, dims.build_dim_hcpcs, dims.build_dim_geography]
)
def test_silver_rows_are_aggregated_by_hash(lake, build):
    """Below every sort aggregation, rows have been reduced by a hash aggregation."""
    text = build(silver(lake))._jdf.queryExecution().sparkPlan().toString()
    lines = [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-*")) for line in text.splitlines()]
    sorts = [k for k, (_, line) in enumerate(lines) if line.startswith("SortAggregate")]
    assert sorts
    for k in sorts:
        below = [line for depth, line in lines[k + 1 :]]
        inside = below[: next((n for n, (depth, _) in enumerate(lines[k + 1 :]) if depth <= lines[k][0]), len(below))]
        scan = next(n for n, line in enumerate(inside) if line.startswith("FileScan"))
        assert any(line.startswith("HashAggregate") for line in inside[:scan])


def test_markup_and_site_marts_broadcast_the_small_dimension(lake):
    codes = lake.table("dim_hcpcs")
    for mart in (marts.credentials_markup, marts.site_neutral):
        assert "BroadcastHashJoin" in plan_of(mart(fact(lake), codes))


def test_large_dimension_is_not_broadcast(spark, lake):
    """No hint forces a broadcast: above the threshold the join is shuffled."""
    codes = lake.table("dim_hcpcs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(marts.site_neutral(fact(lake), codes))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lorenz_never_gathers_rows_in_one_partition(lake):
    """The only single-partition exchange holds one row per range partition."""
    df = marts.jcode_concentration(fact(lake), n_buckets=4)
    lines = plan_of(df).splitlines()
    singles = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    for i in singles:
        below = "\n".join(lines[i + 1 : i + 3])
        assert "_bucket" in below and "npi" not in below
    rows = [line for line in lines if "row_number" in line]
    assert rows and all("[_bucket#" in line for line in rows)
    sorts = [line for line in lines if " Sort [" in line and "npi" in line]
    assert len(sorts) == 1


def test_fact_keeps_the_partitions_of_silver_without_a_shuffle(spark, lake):
    from feescope.operators.fact import build_fact

    assert "Exchange" not in initial_plan(build_fact(silver(lake)))
    assert len(fact(lake).inputFiles()) <= len(silver(lake).inputFiles())


def test_gini_needs_no_sort(lake):
    plan = plan_of(lorenz.gini(lake.table("gold_hero_jcode_concentration")))
    assert "Sort" not in plan and "Window" not in plan


def test_explorer_reduces_the_mart_before_joining(lake):
    df = serving.outlier_explorer(
        lake.table("dim_provider"), lake.table("gold_hero_jcode_concentration")
    )
    plan = plan_of(df)
    assert "Exchange hashpartitioning" not in plan and plan.count("TakeOrderedAndProject") >= 2


def test_foreign_keys_are_counted_before_the_join(spark, lake):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = {name: lake.table(name) for name in quality.KEYS}
        plan = initial_plan(quality.foreign_key_checks(fact(lake), tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    joins = [i for i, line in enumerate(lines) if "SortMergeJoin" in line]
    assert len(joins) == 1
    for i in joins:
        left = "\n".join(lines[i + 1 : i + 5])
        assert "HashAggregate" in left


def test_the_gate_scans_the_fact_once(lake):
    """Row count and all foreign keys come from one scan of the three key columns."""
    plan = initial_plan(lake.check())
    assert len([line for line in scans(plan) if "struct<npi:string,hcpcs_cd:string>" in line]) == 1


def test_silver_checks_scan_once(lake):
    assert len(scans(plan_of(quality.silver_checks(silver(lake))))) == 1


def test_clustered_files_skip_on_filters(spark, lake, tmp_path):
    from feescope.sources import cluster_by

    name = "fact_provider_service"
    clustered = cluster_by(fact(lake), ["hcpcs_cd", "specialty"], 6)
    write_table(clustered, table_path(str(tmp_path), "gold", name))
    back = read_table(spark, str(tmp_path), "gold", name)
    files = back.filter(F.col("hcpcs_cd") == "99213").select(F.input_file_name()).distinct()
    assert files.count() <= 2 and len(back.inputFiles()) >= 5
