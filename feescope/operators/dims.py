"""Provider, procedure and geography dimensions.

Each dimension is two aggregations over the same key, joined afterwards:

* *totals* carry numbers and one exact distinct count. Spark spreads the count
  over (key, counted value) first, so a key with a third of all rows is shared
  by many tasks, and all buffers are fixed width, so hash aggregation applies.
* *profiles* pick descriptive text. Text is no hash-aggregation buffer, so silver rows are first
  grouped by key and all texts together, with the smallest rank as a number: a key has few
  different descriptions, and this combines map-side by hash. The picks are made from those
  few rows.

The join sees one row per key on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import display_name, hcpcs_family
from ..functions.numeric import sum_money
from ..schemas import GOLD_SCHEMAS

c = F.col


_CODE, _PLACE = "HCPCS_Cd", "Place_Of_Srvc"
#: Bytes of code and place that the number holds; what is longer is compared as it is.
_CODE_BYTES, _PLACE_BYTES = 7, 1
_LOWEST = -(2**63)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with the rank of their (code, place of service): one order-preserving number and, as keys, the rest.

    The rest is constant, and so groups nothing apart, unless codes or places are longer than the number holds.
    """

    def head(name: str, size: int) -> Column:
        return F.rpad(F.substring(F.coalesce(c(name), F.lit("")).cast("binary"), 1, size), size, F.lit(b"\0"))

    def tail(name: str, size: int) -> Column:
        return F.expr(f"substring(cast(coalesce(`{name}`, '') as binary), {size + 1})")

    unsigned = F.hex(F.concat(head(_CODE, _CODE_BYTES), head(_PLACE, _PLACE_BYTES)))
    return rows.withColumns(
        {
            "_rank": F.conv(unsigned, 16, -10).cast("long").bitwiseXOR(F.lit(_LOWEST)),
            "_coded": c(_CODE).isNotNull(),
            "_placed": c(_PLACE).isNotNull(),
            "_code_rest": tail(_CODE, _CODE_BYTES),
            "_place_rest": tail(_PLACE, _PLACE_BYTES),
        }
    )


_RANK_KEYS = ["_coded", "_placed", "_code_rest", "_place_rest"]


def first_known(value: Column) -> Column:
    """The non-null value of the row with the smallest (code, place of service), of rows with a ``_rank``.

    Ties go to the smallest value, so the pick does not depend on row order. A missing code or place comes first.
    """
    ranked = F.struct(
        c("_coded"), F.shiftright("_rank", 8 * _PLACE_BYTES), c("_code_rest"),
        c("_placed"), c("_rank").bitwiseAND(F.lit(2 ** (8 * _PLACE_BYTES) - 1)), c("_place_rest"),
        value.alias("value"),
    )
    return F.min(F.when(value.isNotNull(), ranked))["value"]


def _assemble(
    silver: DataFrame, source_key: str, key: str, profile: dict[str, str], totals: dict[str, Column]
) -> DataFrame:
    # Rows without a key form a group of their own. Both sides are grouped and joined by the same two
    # non-null columns, so the join finds them partitioned already.
    keyed = silver.withColumns(
        {"_key": F.coalesce(c(source_key), F.lit("")), "_known": c(source_key).isNotNull()}
    )
    numbers = keyed.groupBy("_key", "_known").agg(
        *[total.alias(name) for name, total in totals.items()]
    )
    # Sources may be keys or parts of the rank themselves, so the texts get their new names first.
    texts = _ranked(keyed).select(
        "_key", "_known", "_rank", *_RANK_KEYS, *[c(source).alias(name) for name, source in profile.items()]
    )
    few = texts.groupBy("_key", "_known", *_RANK_KEYS, *profile).agg(F.min("_rank").alias("_rank"))
    described = few.groupBy("_key", "_known").agg(*[first_known(c(name)).alias(name) for name in profile])
    joined = numbers.join(described, ["_key", "_known"])
    return joined.withColumn(key, F.when(c("_known"), c("_key"))).drop("_key", "_known")


def build_dim_provider(silver: DataFrame) -> DataFrame:
    """One row per NPI."""
    profile = {
        "last_org_name": "Rndrng_Prvdr_Last_Org_Name",
        "first_name": "Rndrng_Prvdr_First_Name",
        "credentials_raw": "Rndrng_Prvdr_Crdntls",
        "provider_tier": "Provider_Tier",
        "ent_cd": "Rndrng_Prvdr_Ent_Cd",
        "is_org": "Is_Org",
        "specialty": "Rndrng_Prvdr_Type",
        "participation": "Rndrng_Prvdr_Mdcr_Prtcptg_Ind",
        "is_participating": "Is_Participating",
        "city": "Rndrng_Prvdr_City",
        "state_abrvtn": "Rndrng_Prvdr_State_Abrvtn",
        "state_fips": "Rndrng_Prvdr_State_FIPS",
        "zip5": "Rndrng_Prvdr_Zip5",
        "ruca_int": "RUCA_Int",
        "ruca_bucket": "RUCA_Bucket",
        "is_rural": "Is_Rural",
    }
    totals = {
        "total_mdcr_pymt": sum_money(c("Tot_Mdcr_Pymt_Amt")),
        "total_services": F.sum("Tot_Srvcs"),
        "n_distinct_hcpcs": F.countDistinct("HCPCS_Cd"),
    }
    dim = _assemble(silver, "Rndrng_NPI", "npi", profile, totals)
    named = dim.withColumns(
        {"display_name": display_name(c("is_org"), c("first_name"), c("last_org_name"))}
    )
    return named.select(*GOLD_SCHEMAS["dim_provider"].fieldNames())


def build_dim_hcpcs(silver: DataFrame) -> DataFrame:
    """One row per procedure code."""
    profile = {
        "hcpcs_desc": "HCPCS_Desc",
        "hcpcs_drug_ind": "HCPCS_Drug_Ind",
        "is_drug": "Is_Drug",
    }
    totals = {
        "national_services": F.sum("Tot_Srvcs"),
        "national_mdcr_pymt": sum_money(c("Tot_Mdcr_Pymt_Amt")),
        "n_providers": F.countDistinct("Rndrng_NPI"),
    }
    dim = _assemble(silver, "HCPCS_Cd", "hcpcs_cd", profile, totals)
    family = dim.withColumns({"hcpcs_family": hcpcs_family(c("hcpcs_cd"))})
    return family.select(*GOLD_SCHEMAS["dim_hcpcs"].fieldNames())


def build_dim_geography(silver: DataFrame) -> DataFrame:
    """One row per state."""
    totals = {
        "n_providers": F.countDistinct("Rndrng_NPI"),
        "total_benes_proxy": F.sum("Tot_Benes"),
        "total_mdcr_pymt": sum_money(c("Tot_Mdcr_Pymt_Amt")),
        "rural_share_of_rows": F.avg(F.when(c("Is_Rural"), 1).otherwise(0)),
        "avg_geo_adj_factor": F.avg("Geo_Adj_Factor"),
    }
    dim = _assemble(
        silver,
        "Rndrng_Prvdr_State_Abrvtn",
        "state_abrvtn",
        {"state_fips": "Rndrng_Prvdr_State_FIPS"},
        totals,
    )
    return dim.select(*GOLD_SCHEMAS["dim_geography"].fieldNames())
