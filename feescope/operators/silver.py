"""Raw text to the typed, enriched service table: one scan, one filter, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    blank_to_null,
    guarded_ratio,
    is_rural,
    money_total,
    ruca_bucket,
    ruca_int,
    service_key,
    whole_number,
)
from ..functions.codes import credential_words, tier_of_words
from ..schemas import RAW_COLUMNS, SILVER_CASTS, SILVER_SCHEMA
from ..session import shared_dir

c = F.col

# Fixed value: release year of the source data.
SOURCE_YEAR = 2023


def trim_to_null(df: DataFrame, cols: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Strip every named column and turn blanks into NULL, in one projection."""
    clean = set(cols)
    return df.select(
        *[blank_to_null(c(n)).alias(n) if n in clean else c(n) for n in df.columns]
    )


def _typed(column: Column, kind: str) -> Column:
    return whole_number(column, kind) if kind in ("int", "long") else column.try_cast(kind)


def apply_casts(df: DataFrame, casts: Mapping[str, str] = SILVER_CASTS) -> DataFrame:
    """Cast the named columns; text that does not parse becomes NULL."""
    return df.select(
        *[_typed(c(n), casts[n]).alias(n) if n in casts else c(n) for n in df.columns]
    )


#: Fixed value: the country whose records are kept.
COUNTRY = "US"


def keep_country(df: DataFrame, country: str = COUNTRY) -> DataFrame:
    """Rows of one country; an unknown country is dropped."""
    return df.filter(c("Rndrng_Prvdr_Cntry") == country)


def geo_premium() -> Column:
    """Dollars paid above the standardised amount."""
    return money_total(c("Avg_Mdcr_Pymt_Amt") - c("Avg_Mdcr_Stdzd_Amt"), c("Tot_Srvcs"))


def patient_exposure() -> Column:
    """Dollars charged above payment, weighted by beneficiaries."""
    return money_total(c("Avg_Sbmtd_Chrg") - c("Avg_Mdcr_Pymt_Amt"), c("Tot_Benes"))


def with_key(df: DataFrame) -> DataFrame:
    key = service_key(c("Rndrng_NPI"), c("HCPCS_Cd"), c("Place_Of_Srvc"))
    return df.withColumns({"service_sk": key})


def with_totals(df: DataFrame) -> DataFrame:
    """Four row totals, the geographic premium and the patient exposure."""
    totals = {
        f"Tot_{amount}": money_total(c(f"Avg_{amount}"), c("Tot_Srvcs"))
        for amount in ("Sbmtd_Chrg", "Mdcr_Alowd_Amt", "Mdcr_Pymt_Amt", "Mdcr_Stdzd_Amt")
    }
    return df.withColumns(
        {**totals, "Geo_Premium": geo_premium(), "Patient_Exposure": patient_exposure()}
    )


def with_ratios(df: DataFrame) -> DataFrame:
    """Markup, payment rate and geographic factor; NULL where the base is not positive."""
    paid, allowed = c("Avg_Mdcr_Pymt_Amt"), c("Avg_Mdcr_Alowd_Amt")
    return df.withColumns(
        {
            "Markup_Ratio": guarded_ratio(c("Avg_Sbmtd_Chrg"), allowed),
            "Mdcr_Pymt_Rate": guarded_ratio(paid, allowed),
            "Geo_Adj_Factor": guarded_ratio(paid, c("Avg_Mdcr_Stdzd_Amt")),
        }
    )


def with_flags(df: DataFrame) -> DataFrame:
    """Four yes/no flags; an unknown indicator gives an unknown flag."""
    yes = {
        "Is_Drug": ("HCPCS_Drug_Ind", "Y"),
        "Is_Facility": ("Place_Of_Srvc", "F"),
        "Is_Participating": ("Rndrng_Prvdr_Mdcr_Prtcptg_Ind", "Y"),
        "Is_Org": ("Rndrng_Prvdr_Ent_Cd", "O"),
    }
    return df.withColumns({flag: c(source) == value for flag, (source, value) in yes.items()})


def with_rurality(df: DataFrame) -> DataFrame:
    coded = df.withColumns({"RUCA_Int": ruca_int(c("Rndrng_Prvdr_RUCA"))})
    return coded.withColumns(
        {"Is_Rural": is_rural(c("RUCA_Int")), "RUCA_Bucket": ruca_bucket(c("RUCA_Int"))}
    )


def with_tier(df: DataFrame) -> DataFrame:
    # The words are a column of their own so that they are computed once per row.
    words = df.withColumns({"_words": credential_words(c("Rndrng_Prvdr_Crdntls"))})
    return words.withColumns({"Provider_Tier": tier_of_words(c("_words"))}).drop("_words")


def with_lineage(
    df: DataFrame, source_year: int = SOURCE_YEAR, run_ts: datetime | Column | None = None
) -> DataFrame:
    """Source year and load time; pass ``run_ts`` to make a rerun identical."""
    if run_ts is None:
        run_ts = F.current_timestamp()
    elif not isinstance(run_ts, Column):
        run_ts = F.lit(run_ts)
    return df.withColumns(
        {"Source_Year": F.lit(source_year), "Ingested_At": run_ts.cast("timestamp")}
    )


def build_silver(
    bronze: DataFrame,
    source_year: int = SOURCE_YEAR,
    run_ts: datetime | Column | None = None,
    together: Sequence[str] = (),
) -> DataFrame:
    """Raw text rows to the silver contract.

    ``together`` names columns whose equal values are brought together, as ``write_table`` does before a partitioned
    write, but ahead of the derived columns: these hardly compress and are more than half of a shuffled row.
    """
    typed = apply_casts(keep_country(trim_to_null(bronze)))
    if together:
        typed = typed.hint("rebalance", *together)
    enriched = with_tier(with_rurality(with_flags(with_ratios(with_totals(with_key(typed))))))
    return with_lineage(enriched, source_year, run_ts).select(*SILVER_SCHEMA.fieldNames())


def dedup_on_service_key(silver: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Opt-in: one row per surrogate key, the smallest by content.

    Off by default because the published pipeline keeps every row. One job counts rows per hash of the key first, and
    only rows whose hash is there twice are grouped; all others pass as they are, without a shuffle of whole rows
    unless there are more than ``broadcast_keys`` repeated hashes. ``min`` of a struct combines map-side, so a key with
    many copies stays cheap.
    """
    shared_dir(silver.sparkSession)
    tag = F.xxhash64("service_sk").alias("_tag")
    counted = silver.select(tag).groupBy("_tag").agg(F.count(F.lit(1)).alias("n"))
    twice = counted.filter(c("n") > 1).select("_tag").checkpoint()
    n_twice = twice.count()
    if not n_twice:
        return silver
    if n_twice <= broadcast_keys:
        twice = F.broadcast(twice)
    tagged = silver.select("*", tag)
    once = tagged.join(twice, "_tag", "left_anti").drop("_tag")
    again = tagged.join(twice, "_tag", "left_semi")
    row = F.struct(*[c(n) for n in silver.columns])
    picked = again.groupBy("service_sk").agg(F.min(row).alias("row"))
    return once.unionByName(picked.select("row.*"))
