from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from feescope.operators import dims, quality as q
from feescope.operators.fact import build_fact

BANDS = {"row_band": (1, 10_000), "geo_band": (1, 65)}


@pytest.fixture
def layers(silver_of):
    """A small, valid set of tables."""
    silver = silver_of(
        {}, {"HCPCS_Cd": "J1"}, {"Rndrng_NPI": "2", "Rndrng_Prvdr_State_Abrvtn": "BX", "Place_Of_Srvc": None}
    )
    return silver, build_fact(silver), {
        "dim_provider": dims.build_dim_provider(silver),
        "dim_hcpcs": dims.build_dim_hcpcs(silver),
        "dim_geography": dims.build_dim_geography(silver),
    }


def failed(report):
    return {r.check_name for r in report.collect() if not r.passed}


def test_valid_tables_pass(layers):
    silver, fact, tables = layers
    report = q.run_checks(silver, fact, tables, **BANDS)
    assert len(q.assert_checks(report)) == 13 and failed(report) == set()
    assert tuple(q.gate(report).first()) == (13, 0, True)


def broken(column, value):
    return lambda df: df.withColumn(column, F.when(F.col("HCPCS_Cd") == "J1", value).otherwise(F.col(column)))


@pytest.mark.parametrize(
    ("check", "change"),
    [
        ("npi_not_null", broken("Rndrng_NPI", None)),
        ("hcpcs_not_null", broken("HCPCS_Cd", None)),
        ("pos_in_domain", broken("Place_Of_Srvc", "X")),
        ("ent_in_domain", broken("Rndrng_Prvdr_Ent_Cd", "Z")),
        ("benes_min_11", broken("Tot_Benes", 10)),
        ("ratios_nonneg", broken("Markup_Ratio", D("-0.1"))),
        ("provider_tier_set", broken("Provider_Tier", None)),
        ("decimal_drift_zero", broken("Tot_Mdcr_Pymt_Amt", D("8000.01"))),
    ],
)
def test_each_silver_check_can_fail(layers, check, change):
    report = q.silver_checks(change(layers[0]))
    assert failed(report) == {check}
    with pytest.raises(q.DataQualityError, match=check):
        q.assert_checks(report)


def test_row_bands_are_exclusive(layers):
    silver, fact, tables = layers
    assert failed(q.row_count_check(fact, "n", (2, 4))) == set()
    assert failed(q.row_count_check(fact, "n", (3, 9))) == {"n"}
    assert failed(q.row_count_check(fact, "n", (0, 3))) == {"n"}
    report = q.run_checks(silver, fact, tables)
    assert failed(report) == {"fact_row_count_band", "dim_geo_reasonable"}


@pytest.mark.parametrize(
    ("name", "check"),
    [
        ("dim_provider", "dim_provider_unique"),
        ("dim_hcpcs", "dim_hcpcs_unique"),
        ("dim_geography", "dim_geo_unique"),
    ],
)
def test_duplicate_dimension_keys_fail(layers, name, check):
    silver, fact, tables = layers
    doubled = tables | {name: tables[name].union(tables[name].limit(1))}
    assert check in failed(q.run_checks(silver, fact, doubled, **BANDS))


def test_null_keys_count_as_one_value(spark):
    one = spark.createDataFrame([("a",), (None,)], "k string")
    assert failed(q.unique_check(one, "u", "k")) == set()
    assert failed(q.unique_check(one.union(one.filter("k IS NULL")), "u", "k")) == {"u"}


def test_duplicate_probes_report_surplus_rows(silver_of, gold_rows):
    silver = silver_of({}, {}, {}, {"HCPCS_Cd": "A"})
    mart = gold_rows(
        "gold_hero_jcode_concentration",
        {"npi": "1", "state_abrvtn": "AX"},
        {"npi": "1", "state_abrvtn": "BX"},
        {"npi": "2"},
    )
    rows = {r.check_name: (r.passed, int(r.observed)) for r in q.duplicate_probes(silver, mart).collect()}
    assert rows == {"service_sk_unique": (False, 2), "jcode_npi_unique": (False, 1)}


def test_orphans(layers):
    _, fact, tables = layers
    assert failed(q.foreign_key_checks(fact, tables)) == set()
    for name, key in q.KEYS.items():
        short = tables | {name: tables[name].filter(F.col(key) != fact.orderBy(key).first()[key])}
        report = {r.check_name: r for r in q.foreign_key_checks(fact, short).collect()}
        assert not report[f"fk_{name}"].passed and report[f"fk_{name}"].observed >= 1
    unknown = fact.withColumn("npi", F.lit(None).cast("string"))
    assert failed(q.foreign_key_checks(unknown, tables)) == set()


def test_row_count_comes_with_the_foreign_keys(layers):
    silver, fact, tables = layers
    n = fact.count()
    for rows, band in ((fact, (n - 1, n + 1)), (fact, (n, None)), (fact.limit(0), (0, None)), (fact.withColumn("npi", F.lit(None).cast("string")), (None, n))):
        (want,) = q.row_count_check(rows, "fact_row_count_band", band).collect()
        report = q.foreign_key_checks(rows, tables, band).collect()
        assert [r for r in report if r.check_name == "fact_row_count_band"] == [want] and len(report) == 4
    names = {r.check_name for r in q.run_checks(silver, None, tables, **BANDS).collect()}
    assert "fact_row_count_band" not in names and len(names) == 12


def test_empty_tables_do_not_pass_silently(layers):
    silver, fact, tables = layers
    report = q.run_checks(silver.limit(0), fact.limit(0), tables, **BANDS)
    assert failed(report) == {"fact_row_count_band"}


def test_content_hash(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    same = df.orderBy(F.desc("a")).repartition(3)
    assert q.content_hash(df).first() == q.content_hash(same).first()
    for other in (
        df.distinct(),
        df.na.fill("x"),
        df.withColumn("a", F.col("a") + 1),
        spark.createDataFrame([(1, "x"), (2, None), (2, "x")], df.schema),
    ):
        assert q.content_hash(df).first() != q.content_hash(other).first()
    stamped = df.withColumn("t", F.rand())
    assert q.content_hash(stamped, ["t"]).first() == q.content_hash(df).first()
    assert q.content_hash(df.limit(0)).first().n_rows == 0


def test_content_hash_by_part_names_what_differs(spark):
    rows = [("CA", 1), ("CA", 2), ("NY", 3), (None, 4), ("TX", 5)]
    df = spark.createDataFrame(rows, "state string, n int")
    other = spark.createDataFrame([("CA", 2), ("CA", 1), ("NY", 7), (None, 4), ("WA", 5)], df.schema)
    parts, others = (q.content_hash(x, by=["state"]) for x in (df, other))
    whole = q.content_hash(df).first()
    assert parts.agg(F.sum("n_rows"), F.sum("content_hash")).first() == tuple(whole)
    changed = {r.state: (r.n_first, r.n_second) for r in q.changed_parts(parts, others, ["state"]).collect()}
    assert changed == {"NY": (1, 1), "TX": (1, 0), "WA": (0, 1)}
    assert q.changed_parts(parts, q.content_hash(df.repartition(4), by=["state"]), ["state"]).isEmpty()
    lost = q.content_hash(df.filter("n != 4"), by=["state"])
    assert [tuple(r) for r in q.changed_parts(parts, lost, ["state"]).collect()] == [(None, 1, 0)]
