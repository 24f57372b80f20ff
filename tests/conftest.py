from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feescope.schemas import GOLD_SCHEMAS, RAW_COLUMNS  # noqa: E402
from feescope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# A complete raw record; tests override what they are about.
RAW = dict.fromkeys(RAW_COLUMNS) | {
    "Rndrng_NPI": "1000000001",
    "Rndrng_Prvdr_Last_Org_Name": "Doe",
    "Rndrng_Prvdr_First_Name": "Jo",
    "Rndrng_Prvdr_Crdntls": "M.D.",
    "Rndrng_Prvdr_Ent_Cd": "I",
    "Rndrng_Prvdr_State_Abrvtn": "AX",
    "Rndrng_Prvdr_State_FIPS": "01",
    "Rndrng_Prvdr_RUCA": "1",
    "Rndrng_Prvdr_Cntry": "US",
    "Rndrng_Prvdr_Type": "Internal",
    "Rndrng_Prvdr_Mdcr_Prtcptg_Ind": "Y",
    "HCPCS_Cd": "99213",
    "HCPCS_Desc": "Visit",
    "HCPCS_Drug_Ind": "N",
    "Place_Of_Srvc": "O",
    "Tot_Benes": "20",
    "Tot_Srvcs": "100",
    "Tot_Bene_Day_Srvcs": "100",
    "Avg_Sbmtd_Chrg": "200.00",
    "Avg_Mdcr_Alowd_Amt": "100.00",
    "Avg_Mdcr_Pymt_Amt": "80.00",
    "Avg_Mdcr_Stdzd_Amt": "75.00",
}


@pytest.fixture
def raw(spark):
    """Build raw records from partial dicts."""
    from feescope.schemas import RAW_SCHEMA

    def build(*records: dict):
        return spark.createDataFrame([RAW | r for r in records], RAW_SCHEMA)

    return build


@pytest.fixture
def silver_of(raw):
    from feescope.operators.silver import build_silver

    return lambda *records: build_silver(raw(*records))


@pytest.fixture
def fact_of(silver_of):
    from feescope.operators.fact import build_fact

    return lambda *records: build_fact(silver_of(*records))


@pytest.fixture
def gold_rows(spark):
    """Build a gold table from partial dicts; unnamed columns are NULL."""

    def build(name: str, *rows: dict):
        schema = GOLD_SCHEMAS[name]
        return spark.createDataFrame([dict.fromkeys(schema.fieldNames()) | r for r in rows], schema)

    return build
