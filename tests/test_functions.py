from __future__ import annotations

from decimal import Decimal as D

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from feescope.functions import (
    blank_to_null,
    clean_identifier,
    display_name,
    guarded_ratio,
    hcpcs_family,
    is_rural,
    money_total,
    provider_tier,
    ruca_bucket,
    ruca_int,
    service_key,
    to_money,
    whole_number,
)
from feescope.schemas import ALL_TIERS, KNOWN_TIERS

c = F.col


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_blank_to_null_strips_spaces_only(spark):
    got = values(spark, ["  a b ", "   ", "", None, "\tx\t", "\t"], blank_to_null(c("v")))
    assert got == ["a b", None, None, None, "\tx\t", "\t"]


def test_whole_numbers_truncate_toward_zero(spark):
    got = values(spark, ["12", "12.9", "-12.9", "1e3", "N/A", None], whole_number(c("v"), "bigint"))
    assert got == [12, 12, -12, 1000, None, None]


def test_money_rounds_half_up_and_overflow_is_null(spark):
    got = values(spark, [0.125, 2.675, -0.125, 1e17], to_money(c("v")), "v double")
    assert got == [D("0.13"), D("2.68"), D("-0.13"), None]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_same_answers_with_ansi_on_and_off(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert values(spark, ["abc", "7.9"], whole_number(c("v"), "int")) == [None, 7]
        assert values(spark, [(1.0, 0.0), (1.0, 3.0)], guarded_ratio(c("a"), c("b")), "a double, b double") == [
            None,
            D("0.333333"),
        ]
        assert values(spark, [(1e15, 1000)], money_total(c("a"), c("b")), "a double, b long") == [None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_guarded_ratio_needs_a_positive_base(spark):
    rows = [(2.0, 3.0), (2.0, 0.0), (2.0, -1.0), (2.0, None), (None, 2.0)]
    got = values(spark, rows, guarded_ratio(c("a"), c("b")), "a double, b double")
    assert got == [D("0.666667"), None, None, None, None]


def test_service_key_skips_null_parts(spark):
    rows = [("1", "2", None), ("1", None, "2"), ("1", "2", "F")]
    a, b, f = values(spark, rows, service_key(c("n"), c("h"), c("p")), "n string, h string, p string")
    import hashlib

    assert a == b == hashlib.sha256(b"1||2").hexdigest()
    assert f == hashlib.sha256(b"1||2||F").hexdigest()


def test_ruca(spark):
    codes = ["1", "3", "4.1", "6", "7", "10", "99", None, "x"]
    assert values(spark, codes, ruca_int(c("v"))) == [1, 3, 4, 6, 7, 10, 99, None, None]
    rural = values(spark, codes, is_rural(ruca_int(c("v"))))
    assert rural == [False, False, True, True, True, True, False, None, None]
    assert values(spark, codes, ruca_bucket(ruca_int(c("v")))) == [
        "Urban",
        "Urban",
        "Large rural",
        "Large rural",
        "Small rural / isolated",
        "Small rural / isolated",
        "Unknown",
        "Unknown",
        "Unknown",
    ]


TIERS = [
    ("M.D.", 0),
    ("MD", 0),
    ("M D", 0),
    ("m. d.", 0),
    ("D.O.", 0),
    ("M.D., F.A.C.S.", 0),
    ("M.D.,PH.D", 0),
    ("PhD, MBBS", 0),
    ("N.P.", 1),
    ("DNP, FNP-BC", 1),
    (" PA-C ", 2),
    ("P.A.", 2),
    ("O.D., F.A.A.O.", 3),
    ("Ph.D.", 3),
    ("CRNA", 3),
    ("Esq.", 4),
    ("MDX", 4),
    ("", 4),
    (None, 4),
    ("123", 4),
]


def test_provider_tier(spark):
    got = values(spark, [t for t, _ in TIERS], provider_tier(c("v")))
    assert got == [ALL_TIERS[i] for _, i in TIERS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), min_size=40, max_size=40))
def test_provider_tier_is_total(spark, texts):
    texts = [t and t.replace("\x00", " ").encode("utf-8", "ignore").decode() for t in texts]
    assert set(values(spark, texts, provider_tier(c("v")))) <= set(ALL_TIERS)


def test_names(spark):
    rows = [(True, "Jo", "Clinic"), (False, "Jo", "Doe"), (None, None, "Doe"), (False, None, None)]
    schema = "o boolean, f string, l string"
    got = values(spark, rows, display_name(c("o"), c("f"), c("l")), schema)
    assert got == ["Clinic", "Jo Doe", "Doe", ""]
    assert values(spark, ["J0897", "99213", None], hcpcs_family(c("v"))) == ["J", "9", None]


def test_clean_identifier():
    assert [clean_identifier(f"{t}_pymt") for t in KNOWN_TIERS] == [
        "Physician_MD_DO_pymt",
        "Nurse_Practitioner_pymt",
        "Physician_Assistant_pymt",
        "Specialist_pymt",
    ]
