from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from feescope.operators import silver as sv
from feescope.operators.quality import content_hash
from feescope.schemas import GOLD_SCHEMAS, SILVER_SCHEMA
from feescope.operators.fact import build_fact


def one(df):
    (row,) = df.collect()
    return row


def types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_contracts(silver_of):
    silver = silver_of({})
    assert types(silver.schema) == types(SILVER_SCHEMA)
    assert types(build_fact(silver).schema) == types(GOLD_SCHEMAS["fact_provider_service"])


def test_derived_columns(silver_of):
    r = one(silver_of({"Tot_Srvcs": "10.7", "Avg_Sbmtd_Chrg": " 33.335 "}))
    assert r.Tot_Srvcs == 10
    assert r.Tot_Sbmtd_Chrg == D("333.35")
    assert r.Tot_Mdcr_Pymt_Amt == D("800.00")
    assert r.Geo_Premium == D("50.00")
    # Weighted by beneficiaries: (33.335 - 80) * 20.
    assert r.Patient_Exposure == D("-933.30")
    assert r.Markup_Ratio == D("0.333350")
    assert r.Mdcr_Pymt_Rate == D("0.800000")
    assert r.Geo_Adj_Factor == D("1.066667")
    assert (r.Is_Drug, r.Is_Facility, r.Is_Participating, r.Is_Org) == (False, False, True, False)
    assert r.Source_Year == 2023 and r.Ingested_At is not None


def test_ratios_divide_doubles(silver_of):
    # 152.39 / 160 is 0.9524375 on paper and 0.9524374999999999 in doubles.
    r = one(silver_of({"Avg_Mdcr_Pymt_Amt": "152.39", "Avg_Mdcr_Stdzd_Amt": "160.0"}))
    assert r.Geo_Adj_Factor == D("0.952437")


def test_unknown_inputs_give_unknown_outputs(silver_of):
    r = one(
        silver_of(
            {
                "Avg_Mdcr_Stdzd_Amt": " ",
                "Avg_Mdcr_Alowd_Amt": "0",
                "HCPCS_Drug_Ind": "",
                "Place_Of_Srvc": None,
                "Rndrng_Prvdr_Mdcr_Prtcptg_Ind": " ",
                "Rndrng_Prvdr_Ent_Cd": None,
                "Rndrng_Prvdr_RUCA": "",
                "Rndrng_Prvdr_Crdntls": None,
                "Tot_Benes": "N/A",
            }
        )
    )
    for name in (
        "Geo_Premium Geo_Adj_Factor Tot_Mdcr_Stdzd_Amt Markup_Ratio Mdcr_Pymt_Rate Patient_Exposure "
        "Is_Drug Is_Facility Is_Participating Is_Org Is_Rural RUCA_Int Tot_Benes"
    ).split():
        assert r[name] is None, name
    assert r.RUCA_Bucket == "Unknown" and r.Provider_Tier == "Other/Unknown"


def test_only_us_rows(silver_of):
    df = silver_of(
        {"Rndrng_Prvdr_Cntry": " US "}, {"Rndrng_Prvdr_Cntry": "CA"}, {"Rndrng_Prvdr_Cntry": None}
    )
    assert df.count() == 1


def test_money_overflow_is_null(silver_of):
    r = one(silver_of({"Avg_Sbmtd_Chrg": "1e15", "Tot_Srvcs": "1000"}))
    assert r.Tot_Sbmtd_Chrg is None and r.Tot_Mdcr_Pymt_Amt == D("80000.00")


def test_run_time_is_a_parameter(raw):
    bronze = raw({}, {"HCPCS_Cd": "99214"})
    when = datetime(2024, 1, 2, 3, 4, 5)
    once, again = (sv.build_silver(bronze, 2022, when) for _ in range(2))
    assert content_hash(once).collect() == content_hash(again).collect()
    assert once.first().Source_Year == 2022
    assert once.select(F.date_format("Ingested_At", "yyyy")).first()[0] == "2024"


def test_dedup_is_opt_in(silver_of):
    silver = silver_of({}, {}, {"Tot_Benes": "99"}, {"HCPCS_Cd": "J1000"})
    assert silver.count() == 4
    kept = sv.dedup_on_service_key(silver).collect()
    assert sorted((r.HCPCS_Cd, r.Tot_Benes) for r in kept) == [("99213", 20), ("J1000", 20)]


@pytest.mark.parametrize("most", [0, 10])
def test_dedup_groups_repeated_keys_alone(silver_of, capsys, most):
    silver = silver_of({}, {"Tot_Benes": "99"}, {"HCPCS_Cd": "J1000"}, {"HCPCS_Cd": "J2000"})
    kept = sv.dedup_on_service_key(silver, broadcast_keys=most)
    assert kept.columns == silver.columns
    assert sorted((r.HCPCS_Cd, r.Tot_Benes) for r in kept.collect()) == [("99213", 20), ("J1000", 20), ("J2000", 20)]
    unique = sv.dedup_on_service_key(silver.filter("Tot_Benes = 20"))
    unique.explain()
    assert "Aggregate" not in capsys.readouterr().out and unique.count() == 3


def test_derived_columns_stay_out_of_the_shuffle(raw):
    bronze, when = raw({}, {"HCPCS_Cd": "99214", "Avg_Mdcr_Stdzd_Amt": " "}), datetime(2024, 1, 2)
    wide, narrow = sv.build_silver(bronze, 2022, when), sv.build_silver(bronze, 2022, when, together=["Rndrng_Prvdr_State_Abrvtn"])
    assert content_hash(wide).collect() == content_hash(narrow).collect()
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RebalancePartitions") :]
    assert "service_sk" not in below and "sha2" not in below and "Geo_Premium" not in below


def test_fact_is_the_same_with_its_derived_columns_left_out_and_added_again(fact_of):
    from feescope.operators.fact import DERIVED, with_derived

    fact = fact_of({}, {"Avg_Mdcr_Stdzd_Amt": "0", "HCPCS_Cd": ""}, {"Tot_Srvcs": "N/A"}, {"Tot_Benes": ""})
    assert len(DERIVED) == 10
    back = with_derived(fact.drop(*DERIVED))
    assert back.schema == fact.schema and sorted(map(str, back.collect())) == sorted(map(str, fact.collect()))


def test_generated_method_is_small_enough_for_the_jit(raw, capsys):
    """HotSpot interprets methods above 8000 bytes of bytecode."""
    import re

    sv.build_silver(raw({})).explain(mode="codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
