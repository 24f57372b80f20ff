"""The narrow fact: a renaming projection of silver, without descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import service_key
from ..schemas import GOLD_SCHEMAS
from .silver import with_ratios, with_totals

# Fact name for each renamed silver column; all others keep theirs.
FACT_NAMES = {
    "npi": "Rndrng_NPI",
    "specialty": "Rndrng_Prvdr_Type",
    "provider_tier": "Provider_Tier",
    "state_abrvtn": "Rndrng_Prvdr_State_Abrvtn",
    "ruca_int": "RUCA_Int",
    "ruca_bucket": "RUCA_Bucket",
    "is_rural": "Is_Rural",
    "is_participating": "Is_Participating",
    "is_org": "Is_Org",
    "hcpcs_cd": "HCPCS_Cd",
    "is_drug": "Is_Drug",
    "place_of_srvc": "Place_Of_Srvc",
    "is_facility": "Is_Facility",
}


_NAMES = GOLD_SCHEMAS["fact_provider_service"].fieldNames()
# Columns that follow from others of the same row.
DERIVED = ["service_sk", *[n for n in _NAMES if n.endswith(("_Ratio", "_Rate", "_Factor", "_Premium", "_Exposure"))],
           *[n for n in _NAMES if n.startswith("Tot_") and n.endswith(("_Chrg", "_Amt"))]]


def with_derived(narrow: DataFrame) -> DataFrame:
    """A fact whose ``DERIVED`` columns were left out of a shuffle, with them again, by silver's own expressions."""
    key = service_key(F.col("npi"), F.col("hcpcs_cd"), F.col("place_of_srvc"))
    return with_ratios(with_totals(narrow.withColumns({"service_sk": key}))).select(*_NAMES)


def build_fact(silver: DataFrame) -> DataFrame:
    return silver.select(*[F.col(FACT_NAMES.get(n, n)).alias(n) for n in _NAMES])
