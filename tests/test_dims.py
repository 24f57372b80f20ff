from __future__ import annotations

from decimal import Decimal as D

from feescope.operators import dims
from feescope.schemas import GOLD_SCHEMAS


def by(df, key):
    return {r[key]: r for r in df.collect()}


def types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


RECORDS = [
    {"HCPCS_Cd": "B", "Rndrng_Prvdr_City": "Second", "Rndrng_Prvdr_First_Name": "Late"},
    {"HCPCS_Cd": "A", "Rndrng_Prvdr_City": "First", "Rndrng_Prvdr_First_Name": None},
    {"HCPCS_Cd": "A", "Place_Of_Srvc": "F", "Rndrng_Prvdr_City": None},
    {
        "Rndrng_NPI": "2",
        "HCPCS_Cd": "A",
        "Rndrng_Prvdr_State_Abrvtn": "BX",
        "Rndrng_Prvdr_RUCA": "7",
        "Rndrng_Prvdr_Ent_Cd": "O",
        "HCPCS_Desc": "Alternative",
        "Avg_Mdcr_Stdzd_Amt": "0",
    },
    {"Rndrng_NPI": None, "HCPCS_Cd": "A", "Rndrng_Prvdr_State_Abrvtn": None},
]


def test_provider_picks_by_smallest_code_and_place(silver_of):
    dim = dims.build_dim_provider(silver_of(*RECORDS))
    assert types(dim.schema) == types(GOLD_SCHEMAS["dim_provider"])
    rows = by(dim, "npi")
    first = rows["1000000001"]
    # Smallest (code, place) is (A, F), whose city is NULL; (A, O) comes next.
    assert first.city == "First"
    # (A, F) carries the default first name and wins over (B, O).
    assert first.first_name == "Jo"
    assert first.n_distinct_hcpcs == 2 and first.total_services == 300
    assert first.total_mdcr_pymt == D("24000.00")
    assert rows["2"].display_name == "Doe" and rows["2"].is_org
    # Rows without a provider form one group, joined like any other.
    assert len(rows) == 3
    assert rows[None].first_name == "Jo" and rows[None].n_distinct_hcpcs == 1


def test_conflicting_copies_do_not_depend_on_row_order(spark, silver_of):
    silver = silver_of({"Rndrng_Prvdr_City": "Z"}, {"Rndrng_Prvdr_City": "A"})
    for n in (1, 2, 5):
        assert dims.build_dim_provider(silver.repartition(n)).first().city == "A"


def test_codes(silver_of):
    dim = dims.build_dim_hcpcs(silver_of(*RECORDS))
    assert types(dim.schema) == types(GOLD_SCHEMAS["dim_hcpcs"])
    rows = by(dim, "hcpcs_cd")
    # Smallest place is F; it has the default description.
    assert rows["A"].hcpcs_desc == "Visit" and rows["A"].hcpcs_family == "A"
    # An unknown provider is not counted.
    assert rows["A"].n_providers == 2 and rows["A"].national_services == 400


def test_geography(silver_of):
    dim = dims.build_dim_geography(silver_of(*RECORDS))
    assert types(dim.schema) == types(GOLD_SCHEMAS["dim_geography"])
    rows = by(dim, "state_abrvtn")
    assert set(rows) == {"AX", "BX", None}
    assert rows["BX"].rural_share_of_rows == 1.0 and rows["BX"].avg_geo_adj_factor is None
    assert rows["AX"].avg_geo_adj_factor == D("1.0666670000")
    assert rows["AX"].n_providers == 1 and rows["AX"].total_benes_proxy == 60


def test_totals_are_conserved(silver_of):
    silver = silver_of(*RECORDS)
    total = silver.groupBy().sum("Tot_Mdcr_Pymt_Amt").first()[0]
    for dim, name in (
        (dims.build_dim_provider(silver), "total_mdcr_pymt"),
        (dims.build_dim_hcpcs(silver), "national_mdcr_pymt"),
        (dims.build_dim_geography(silver), "total_mdcr_pymt"),
    ):
        assert dim.groupBy().sum(name).first()[0] == total


def test_ranks_of_long_and_missing_codes(spark, silver_of):
    """Codes and places beyond what the number holds, missing ones and other alphabets, against plain tuples."""
    codes = [None, "A", "AAAAAAA", "AAAAAAAB", "AAAAAAAA", "AAAAAAABZZ", "\u00e9", "\u00e9clair-long-code", "~", "AAAAAA\u00e9x"]
    places = [None, "F", "O", "FF", "FA", "\u00e9"]
    rows = [
        {"HCPCS_Cd": code, "Place_Of_Srvc": place, "Rndrng_Prvdr_City": f"{i} {j}", "Rndrng_NPI": str(n)}
        for n in range(8) for i, code in enumerate(codes) for j, place in enumerate(places) if (i * 7 + j * 3 + n) % 8 > n - 2
    ]
    key = lambda x: (x is not None, (x or "").encode())
    want = {}
    for r in sorted(rows, key=lambda r: (key(r["HCPCS_Cd"]), key(r["Place_Of_Srvc"]))):
        want.setdefault(r["Rndrng_NPI"], r["Rndrng_Prvdr_City"])
    found = by(dims.build_dim_provider(silver_of(*rows).repartition(5)), "npi")
    assert {n: r.city for n, r in found.items()} == want
