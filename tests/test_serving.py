from __future__ import annotations

from decimal import Decimal as D

import pytest

from feescope.operators import serving as sv


@pytest.fixture
def providers(gold_rows):
    base = {"specialty": "A", "state_abrvtn": "AX", "ruca_bucket": "Urban", "is_participating": True}
    return gold_rows(
        "dim_provider",
        base | {"npi": "1", "total_mdcr_pymt": D(30), "total_services": 3, "n_distinct_hcpcs": 1},
        base
        | {"npi": "2", "state_abrvtn": "BX", "total_mdcr_pymt": D(20), "total_services": 2}
        | {"n_distinct_hcpcs": 4, "is_participating": False},
        base
        | {"npi": "3", "specialty": "B", "ruca_bucket": "Large rural", "total_mdcr_pymt": D(20)}
        | {"n_distinct_hcpcs": 2, "is_participating": None},
        {"npi": "4", "n_distinct_hcpcs": 9},
    )


def npis(df):
    return [r.npi for r in df.orderBy("npi").collect()]


def test_filters_are_conjunctive_and_optional(providers):
    assert npis(sv.apply_filters(providers)) == ["1", "2", "3", "4"]
    assert npis(sv.apply_filters(providers, [], [], "(All)")) == ["1", "2", "3", "4"]
    assert npis(sv.apply_filters(providers, states=["AX"])) == ["1", "3"]
    assert npis(sv.apply_filters(providers, ["AX", "BX"], ["A"], "Urban")) == ["1", "2"]
    assert npis(sv.apply_filters(providers, ["AX"], ["A"], "Large rural")) == []


def test_kpis(providers):
    row = sv.kpi_ribbon(providers).first()
    assert row.total_mdcr_pymt == D("70.00") and row.total_services == 5 and row.n_providers == 4
    # One of the two providers with known participation does not take part.
    assert row.non_par_pct == D("50.000000")
    # Median of 1, 2, 4, 9 is 3.
    assert row.median_codes == 3
    assert sv.kpi_ribbon(providers, states=["AX"]).first().median_codes == 1


def test_kpis_of_nothing_are_zero(providers):
    assert list(sv.kpi_ribbon(providers, states=["none"]).first()) == [0, 0, 0, 0, 0]


def test_filter_options(providers):
    assert [r[0] for r in sv.filter_options(providers, "state_abrvtn").collect()] == ["AX", "BX"]


def test_geo_by_state(gold_rows):
    mart = gold_rows(
        "gold_hero_geo_arbitrage",
        {"state_abrvtn": "AX", "total_geo_premium": D(10), "total_benes_proxy": 3},
        {"state_abrvtn": "AX", "total_geo_premium": D(-30), "total_benes_proxy": 3},
        {"state_abrvtn": "BX", "total_geo_premium": D(1), "total_benes_proxy": 0},
    )
    rows = {r.state_abrvtn: r for r in sv.geo_by_state(mart).collect()}
    assert rows["AX"].geo_premium_per_bene == D("-3.333333")
    assert rows["BX"].geo_premium_per_bene is None


def states(spark, n):
    rows = [(f"S{i:02d}", D(i), 1, D(i)) for i in range(n)]
    schema = (
        "state_abrvtn string, total_geo_premium decimal(18,2), total_benes_proxy long, "
        "geo_premium_per_bene decimal(12,6)"
    )
    return spark.createDataFrame(rows, schema)


def test_tornado(spark):
    got = [int(r.geo_premium_per_bene) for r in sv.tornado(states(spark, 30)).collect()]
    assert got == [*range(10), *range(20, 30)]
    # Fewer than twenty states: the middle ones are in both lists.
    few = [int(r.geo_premium_per_bene) for r in sv.tornado(states(spark, 12)).collect()]
    assert len(few) == 20 and few == sorted(few) and few.count(5) == 2 and few.count(0) == 1


def test_top_non_par(gold_rows):
    rows = [
        {
            "specialty": f"S{i:02d}",
            "non_par_premium_pct": D(i),
            "exposure_par_Y": D(100),
            "exposure_par_N": D(100 + i),
        }
        for i in range(14)
    ]
    mart = gold_rows("gold_hero_non_par_premium", *rows, {"specialty": "unknown"})
    got = sv.top_non_par(mart).collect()
    assert len(got) == 24 and {r.specialty for r in got} == {f"S{i:02d}" for i in range(2, 14)}
    last = {r.side: r.exposure for r in got if r.specialty == "S13"}
    assert last == {"Participating (Y)": D(100), "Non-Par (N)": D(113)}


def test_top_drug_codes(gold_rows):
    codes = gold_rows(
        "dim_hcpcs",
        {"hcpcs_cd": "J2", "is_drug": True, "national_mdcr_pymt": D(5)},
        {"hcpcs_cd": "J1", "is_drug": True, "national_mdcr_pymt": D(5)},
        {"hcpcs_cd": "J3", "is_drug": True, "national_mdcr_pymt": D(9)},
        {"hcpcs_cd": "X", "is_drug": False, "national_mdcr_pymt": D(99)},
        {"hcpcs_cd": "Y", "national_mdcr_pymt": D(99)},
    )
    assert [r.hcpcs_cd for r in sv.top_drug_codes(codes, 2).collect()] == ["J3", "J1"]


def test_markup_long(gold_rows):
    name = "gold_hero_credentials_markup"
    mart = gold_rows(
        name,
        {
            "hcpcs_cd": "99213",
            "hcpcs_desc": "Visit",
            "is_shared_e_and_m": True,
            "Physician_MD_DO_markup": D(2),
            "Physician_MD_DO_svcs": 7,
            "Specialist_markup": D(3),
            "Nurse_Practitioner_svcs": 5,
        },
        {"hcpcs_cd": "J1", "is_shared_e_and_m": False, "Specialist_markup": D(9)},
    )
    got = {(r.hcpcs_cd, r.provider_tier): (r.markup_ratio, r.services) for r in sv.markup_long(mart).collect()}
    assert got == {
        ("99213", "Physician (MD/DO)"): (D(2), 7),
        ("99213", "Specialist"): (D(3), 0),
    }


def test_markup_long_without_shared_codes_shows_the_first_codes(gold_rows):
    rows = [
        {"hcpcs_cd": f"J{i}", "is_shared_e_and_m": False, "Specialist_markup": D(i)} for i in range(9)
    ]
    mart = gold_rows("gold_hero_credentials_markup", *rows)
    assert sorted(r.hcpcs_cd for r in sv.markup_long(mart).collect()) == [f"J{i}" for i in range(6)]


def test_markup_long_builds_the_mart_once(spark, gold_rows):
    mart = gold_rows("gold_hero_credentials_markup", {"hcpcs_cd": "J1", "is_shared_e_and_m": False, "Specialist_markup": D(9)})
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert sv.markup_long(mart.mapInArrow(counted, mart.schema)).count() == 1
    assert seen.value == 1


def test_site_headline_and_scatter(gold_rows):
    mart = gold_rows(
        "gold_hero_site_neutral",
        {"hcpcs_cd": "A", "F_pymt": D(10), "O_pymt": D(20), "F_svcs": 50, "site_neutral_savings": D(-5)},
        {"hcpcs_cd": "B", "F_pymt": D(8), "O_pymt": D(4), "F_svcs": 200, "site_neutral_savings": D(7)},
        {"hcpcs_cd": "C", "F_pymt": D(99), "F_svcs": 999, "site_neutral_savings": None},
    )
    assert sv.site_savings_total(mart).first()[0] == D("7.00")
    rows = {r.hcpcs_cd: r for r in sv.site_scatter(mart).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].relative_volume == D("0.250000")
    assert rows["A"].axis_max == D("21.0000")


def test_explorer_fans_out_providers_with_two_groups(gold_rows, providers):
    mart = gold_rows(
        "gold_hero_jcode_concentration",
        {"npi": "2", "state_abrvtn": "BX", "drug_share": D("0.1"), "is_drug_dependent": False},
        {"npi": "2", "state_abrvtn": "CX", "drug_share": D("0.9"), "is_drug_dependent": True},
        {"npi": "9", "drug_share": D(1)},
    )
    everyone = sv.outlier_explorer(providers, mart).collect()
    assert [(r.npi, r.drug_share) for r in everyone] == [
        ("1", None),
        ("2", D("0.900000")),
        ("2", D("0.100000")),
        ("3", None),
        ("4", None),
    ]
    # Picking providers before the join gives the same rows as sorting afterwards.
    by_payment = sv.provider_outliers(providers, mart).orderBy(
        "total_mdcr_pymt", ascending=False
    )
    assert by_payment.count() == 5
    for k in range(1, 6):
        assert [tuple(r) for r in sv.outlier_explorer(providers, mart, k=k).collect()] == [
            tuple(r) for r in everyone[:k]
        ]
    assert [r.npi for r in sv.outlier_explorer(providers, mart, states=["BX"]).collect()] == ["2", "2"]
