"""Column contracts: raw input, typed layer, dimensions, fact and marts.

Everything that reads or writes a table takes its column names and types from
here, so a contract is stated once and checked in one place.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The storage types of dollars and of ratios.
MONEY = DecimalType(18, 2)
RATIO = DecimalType(12, 6)
# Spark's result type for avg(RATIO); it is part of the published contract.
AVG_RATIO = DecimalType(16, 10)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "long": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
    "money": MONEY,
    "ratio": RATIO,
    "avg_ratio": AVG_RATIO,
}


def _table(columns: dict[str, str]) -> StructType:
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


# The 28 raw columns, all text, in file order.
RAW_COLUMNS = [
    "Rndrng_NPI",
    "Rndrng_Prvdr_Last_Org_Name",
    "Rndrng_Prvdr_First_Name",
    "Rndrng_Prvdr_MI",
    "Rndrng_Prvdr_Crdntls",
    "Rndrng_Prvdr_Ent_Cd",
    "Rndrng_Prvdr_St1",
    "Rndrng_Prvdr_St2",
    "Rndrng_Prvdr_City",
    "Rndrng_Prvdr_State_Abrvtn",
    "Rndrng_Prvdr_State_FIPS",
    "Rndrng_Prvdr_Zip5",
    "Rndrng_Prvdr_RUCA",
    "Rndrng_Prvdr_RUCA_Desc",
    "Rndrng_Prvdr_Cntry",
    "Rndrng_Prvdr_Type",
    "Rndrng_Prvdr_Mdcr_Prtcptg_Ind",
    "HCPCS_Cd",
    "HCPCS_Desc",
    "HCPCS_Drug_Ind",
    "Place_Of_Srvc",
    "Tot_Benes",
    "Tot_Srvcs",
    "Tot_Bene_Day_Srvcs",
    "Avg_Sbmtd_Chrg",
    "Avg_Mdcr_Alowd_Amt",
    "Avg_Mdcr_Pymt_Amt",
    "Avg_Mdcr_Stdzd_Amt",
]

# File sources ignore a non-null flag, so required keys are enforced by the
# quality checks, not here.
RAW_SCHEMA = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])

# The typed columns of the silver layer.
SILVER_CASTS = {
    "Tot_Benes": "int",
    "Tot_Srvcs": "long",
    "Tot_Bene_Day_Srvcs": "long",
    "Avg_Sbmtd_Chrg": "double",
    "Avg_Mdcr_Alowd_Amt": "double",
    "Avg_Mdcr_Pymt_Amt": "double",
    "Avg_Mdcr_Stdzd_Amt": "double",
}

# Provider tiers, rurality buckets and shared E&M codes.
PHYSICIAN = "Physician (MD/DO)"
NURSE_PRACTITIONER = "Nurse Practitioner"
PHYSICIAN_ASSISTANT = "Physician Assistant"
SPECIALIST = "Specialist"
OTHER_TIER = "Other/Unknown"
KNOWN_TIERS = [PHYSICIAN, NURSE_PRACTITIONER, PHYSICIAN_ASSISTANT, SPECIALIST]
ALL_TIERS = [*KNOWN_TIERS, OTHER_TIER]
RUCA_BUCKETS = ["Urban", "Large rural", "Small rural / isolated", "Unknown"]
SHARED_E_AND_M = ["99213", "99214", "99203", "99204", "99212", "99215"]

# The silver table, its name and derived columns.
SILVER = "physician_by_provider_service"
SILVER_SCHEMA = StructType(
    [StructField(c, _TYPES[SILVER_CASTS.get(c, "string")], True) for c in RAW_COLUMNS]
    + _table(
        {
            "service_sk": "string",
            "Tot_Sbmtd_Chrg": "money",
            "Tot_Mdcr_Alowd_Amt": "money",
            "Tot_Mdcr_Pymt_Amt": "money",
            "Tot_Mdcr_Stdzd_Amt": "money",
            "Geo_Premium": "money",
            "Patient_Exposure": "money",
            "Markup_Ratio": "ratio",
            "Mdcr_Pymt_Rate": "ratio",
            "Geo_Adj_Factor": "ratio",
            "Is_Drug": "boolean",
            "Is_Facility": "boolean",
            "Is_Participating": "boolean",
            "Is_Org": "boolean",
            "RUCA_Int": "int",
            "Is_Rural": "boolean",
            "RUCA_Bucket": "string",
            "Provider_Tier": "string",
            "Source_Year": "int",
            "Ingested_At": "timestamp",
        }
    ).fields
)

# Names, order and types of the columns of every gold table.
GOLD_SCHEMAS = {
    "dim_provider": _table(
        {
            "npi": "string",
            "last_org_name": "string",
            "first_name": "string",
            "credentials_raw": "string",
            "provider_tier": "string",
            "ent_cd": "string",
            "is_org": "boolean",
            "specialty": "string",
            "participation": "string",
            "is_participating": "boolean",
            "city": "string",
            "state_abrvtn": "string",
            "state_fips": "string",
            "zip5": "string",
            "ruca_int": "int",
            "ruca_bucket": "string",
            "is_rural": "boolean",
            "total_mdcr_pymt": "money",
            "total_services": "long",
            "n_distinct_hcpcs": "long",
            "display_name": "string",
        }
    ),
    "dim_hcpcs": _table(
        {
            "hcpcs_cd": "string",
            "hcpcs_desc": "string",
            "hcpcs_drug_ind": "string",
            "is_drug": "boolean",
            "national_services": "long",
            "national_mdcr_pymt": "money",
            "n_providers": "long",
            "hcpcs_family": "string",
        }
    ),
    "dim_geography": _table(
        {
            "state_abrvtn": "string",
            "state_fips": "string",
            "n_providers": "long",
            "total_benes_proxy": "long",
            "total_mdcr_pymt": "money",
            "rural_share_of_rows": "double",
            "avg_geo_adj_factor": "avg_ratio",
        }
    ),
    "fact_provider_service": _table(
        {
            "service_sk": "string",
            "npi": "string",
            "specialty": "string",
            "provider_tier": "string",
            "state_abrvtn": "string",
            "ruca_int": "int",
            "ruca_bucket": "string",
            "is_rural": "boolean",
            "is_participating": "boolean",
            "is_org": "boolean",
            "hcpcs_cd": "string",
            "is_drug": "boolean",
            "place_of_srvc": "string",
            "is_facility": "boolean",
            "Tot_Benes": "int",
            "Tot_Srvcs": "long",
            "Tot_Bene_Day_Srvcs": "long",
            "Avg_Sbmtd_Chrg": "double",
            "Avg_Mdcr_Alowd_Amt": "double",
            "Avg_Mdcr_Pymt_Amt": "double",
            "Avg_Mdcr_Stdzd_Amt": "double",
            "Tot_Sbmtd_Chrg": "money",
            "Tot_Mdcr_Alowd_Amt": "money",
            "Tot_Mdcr_Pymt_Amt": "money",
            "Tot_Mdcr_Stdzd_Amt": "money",
            "Markup_Ratio": "ratio",
            "Mdcr_Pymt_Rate": "ratio",
            "Geo_Adj_Factor": "ratio",
            "Geo_Premium": "money",
            "Patient_Exposure": "money",
        }
    ),
    "gold_hero_geo_arbitrage": _table(
        {
            "state_abrvtn": "string",
            "ruca_bucket": "string",
            "total_geo_premium": "money",
            "total_pymt": "money",
            "total_stdzd": "money",
            "total_benes_proxy": "long",
            "total_services": "long",
            "avg_geo_adj_factor": "avg_ratio",
            "geo_premium_per_bene": "money",
        }
    ),
    "gold_hero_non_par_premium": _table(
        {
            "specialty": "string",
            "exposure_par_Y": "money",
            "n_providers_Y": "long",
            "total_mdcr_pymt_Y": "money",
            "exposure_par_N": "money",
            "n_providers_N": "long",
            "total_mdcr_pymt_N": "money",
            "non_par_premium_pct": "ratio",
        }
    ),
    "gold_hero_jcode_concentration": _table(
        {
            "npi": "string",
            "specialty": "string",
            "state_abrvtn": "string",
            "drug_mdcr_pymt": "money",
            "drug_services": "long",
            "total_mdcr_pymt": "money",
            "drug_share": "ratio",
            "is_drug_dependent": "boolean",
            "cum_share_providers": "ratio",
            "cum_share_drug": "ratio",
        }
    ),
    "gold_hero_credentials_markup": _table(
        {
            "hcpcs_cd": "string",
            "is_shared_e_and_m": "boolean",
            "Physician_MD_DO_markup": "ratio",
            "Physician_MD_DO_pymt": "money",
            "Physician_MD_DO_svcs": "long",
            "Nurse_Practitioner_markup": "ratio",
            "Nurse_Practitioner_pymt": "money",
            "Nurse_Practitioner_svcs": "long",
            "Physician_Assistant_markup": "ratio",
            "Physician_Assistant_pymt": "money",
            "Physician_Assistant_svcs": "long",
            "Specialist_markup": "ratio",
            "Specialist_pymt": "money",
            "Specialist_svcs": "long",
            "hcpcs_desc": "string",
        }
    ),
    "gold_hero_site_neutral": _table(
        {
            "hcpcs_cd": "string",
            "F_pymt": "money",
            "F_svcs": "long",
            "F_total": "money",
            "O_pymt": "money",
            "O_svcs": "long",
            "O_total": "money",
            "site_ratio": "ratio",
            "site_neutral_savings": "money",
            "hcpcs_desc": "string",
            "is_drug": "boolean",
        }
    ),
}

# Physical layout: partition columns, then the columns each table is clustered on.
PARTITIONS = {
    SILVER: ["Rndrng_Prvdr_State_Abrvtn"],
    "fact_provider_service": ["state_abrvtn"],
    "gold_hero_geo_arbitrage": ["state_abrvtn"],
}
CLUSTERING = {
    SILVER: ["HCPCS_Cd", "Rndrng_Prvdr_Type"],
    "fact_provider_service": ["hcpcs_cd", "specialty"],
    "dim_provider": ["npi"],
    "dim_hcpcs": ["hcpcs_cd"],
    "gold_hero_geo_arbitrage": ["ruca_bucket"],
    "gold_hero_credentials_markup": ["hcpcs_cd"],
    "gold_hero_site_neutral": ["site_ratio"],
}
# Tables that queries filter and that grow with the data get files with disjoint key ranges, inside
# each partition value where there are partitions. Silver is sorted inside its files only: a range
# exchange samples its input first, and would parse all raw text twice. The others have a row per code
# at most; one sorted file serves them.
RANGE_CLUSTERED = ["fact_provider_service", "dim_provider"]


def schema_of(layer: str, name: str) -> StructType | None:
    """The declared contract of a table, or None for a table we do not own."""
    if layer == "silver" and name == SILVER:
        return SILVER_SCHEMA
    return GOLD_SCHEMAS.get(name) if layer == "gold" else None
