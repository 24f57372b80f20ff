"""Queries behind the dashboards: filters, headline numbers, top-k lists, reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean_identifier, guarded_ratio, to_money, to_ratio
from ..functions.numeric import sum_money
from ..schemas import KNOWN_TIERS
from ..session import shared_dir

c = F.col

# Fixed value: the filter choice that keeps all rows.
ANY = "(All)"


def apply_filters(
    df: DataFrame,
    states: Sequence[str] | None = None,
    specialties: Sequence[str] | None = None,
    ruca: str | None = None,
) -> DataFrame:
    """Keep rows that meet every given filter; an empty filter keeps all.

    Written on plain columns, so it reaches the Parquet scan, and the state
    filter prunes partitions of tables partitioned by state.
    """
    if states:
        df = df.filter(c("state_abrvtn").isin(*states))
    if specialties:
        df = df.filter(c("specialty").isin(*specialties))
    if ruca and ruca != ANY:
        df = df.filter(c("ruca_bucket") == ruca)
    return df


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in every named column."""
    return df.dropna(how="any", subset=list(cols))


def filter_options(dim_provider: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values to offer in a filter."""
    return drop_null(dim_provider.select(col), [col]).distinct().orderBy(col)


def kpi_ribbon(dim_provider: DataFrame, **filters) -> DataFrame:
    """Headline numbers of the filtered providers: one row, zeros if none is left.

    The exact median keeps a count per distinct value, and a value here is a
    number of codes, so its state is bounded by the code list. The distinct
    count is a query of its own; mixed with a median it would build one median
    state per provider.
    """
    chosen = apply_filters(dim_provider, **filters)
    n_providers = chosen.select(F.countDistinct("npi")).scalar()
    known = F.count("is_participating")
    non_par = F.count_if(~c("is_participating"))
    zero = F.lit(0)
    return chosen.agg(
        F.coalesce(sum_money(c("total_mdcr_pymt")), to_money(zero)).alias("total_mdcr_pymt"),
        F.coalesce(F.sum("total_services"), zero.cast("bigint")).alias("total_services"),
        n_providers.alias("n_providers"),
        F.when(F.count(F.lit(1)) == 0, to_ratio(zero))
        .otherwise(guarded_ratio(F.lit(100) * non_par, known))
        .alias("non_par_pct"),
        F.coalesce(F.median("n_distinct_hcpcs").try_cast("int"), zero).alias("median_codes"),
    )


# --- Geography ---------------------------------------------------------------


def geo_by_state(mart: DataFrame) -> DataFrame:
    """Mart 1 summed to states, with the ratio recomputed from the sums."""
    premium, benes = sum_money(c("total_geo_premium")), F.sum("total_benes_proxy")
    return mart.groupBy("state_abrvtn").agg(
        premium.alias("total_geo_premium"),
        benes.alias("total_benes_proxy"),
        guarded_ratio(premium, benes).alias("geo_premium_per_bene"),
    )


def tornado(by_state: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest and ``k`` lowest states, sorted; with few states some appear twice."""
    premium = c("geo_premium_per_bene")
    top = by_state.orderBy(premium.desc_nulls_last(), "state_abrvtn").limit(k)
    bottom = by_state.orderBy(premium.asc_nulls_last(), "state_abrvtn").limit(k)
    return top.unionByName(bottom).orderBy(premium, "state_abrvtn")


# --- Participation -----------------------------------------------------------


def top_non_par(mart: DataFrame, k: int = 12) -> DataFrame:
    """Two points (participating, non-participating) for the ``k`` highest premiums."""
    pct = c("non_par_premium_pct")
    top = drop_null(mart, ["non_par_premium_pct"]).orderBy(pct.desc(), "specialty").limit(k)
    points = top.unpivot(
        ["specialty", "non_par_premium_pct"],
        ["exposure_par_Y", "exposure_par_N"],
        "side",
        "exposure",
    )
    # The two labels.
    label = F.when(c("side") == "exposure_par_Y", "Participating (Y)").otherwise("Non-Par (N)")
    return points.withColumn("side", label)


# --- Drugs -------------------------------------------------------------------


def top_drug_codes(dim_hcpcs: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` drug codes with the highest national payment."""
    drugs = dim_hcpcs.filter("is_drug").select("hcpcs_cd", "hcpcs_desc", "national_mdcr_pymt")
    return drugs.orderBy(c("national_mdcr_pymt").desc_nulls_last(), "hcpcs_cd").limit(k)


# --- Credentials -------------------------------------------------------------


def markup_long(mart: DataFrame, fallback_codes: int = 6) -> DataFrame:
    """Mart 4 as one row per (code, tier) for the shared E&M codes.

    Without any such code, the first codes in order stand in. NULL markups are
    dropped and NULL services read as 0. The mart, a row per code, is looked at three times, and so is
    built once and kept in the checkpoint folder.
    """
    shared_dir(mart.sparkSession)
    mart = mart.checkpoint()
    shared = mart.filter("is_shared_e_and_m")
    n_shared = shared.select(F.count(F.lit(1))).scalar()
    first_codes = mart.orderBy("hcpcs_cd").limit(fallback_codes).filter(n_shared == 0)
    shown = shared.unionByName(first_codes)

    def point(tier: str) -> Column:
        prefix = clean_identifier(tier)
        return F.struct(
            F.lit(tier).alias("provider_tier"),
            c(f"{prefix}_markup").alias("markup_ratio"),
            F.coalesce(c(f"{prefix}_svcs"), F.lit(0)).alias("services"),
        )

    tiers = F.array(*map(point, KNOWN_TIERS))
    long = shown.select("hcpcs_cd", "hcpcs_desc", F.inline(tiers))
    return drop_null(long, ["markup_ratio"])


# --- Site of service ---------------------------------------------------------


def site_savings_total(mart: DataFrame) -> DataFrame:
    """Headline savings: positive savings only."""
    saved = sum_money(F.greatest(c("site_neutral_savings"), F.lit(0)))
    return mart.agg(F.coalesce(saved, to_money(F.lit(0))).alias("total_savings"))


def site_scatter(mart: DataFrame) -> DataFrame:
    """Codes paid at both sites, with relative facility volume and the axis limit."""
    both = drop_null(mart, ["F_pymt", "O_pymt"])
    largest = both.select(F.max("F_svcs")).scalar()
    highest = both.select(F.greatest(F.max("F_pymt"), F.max("O_pymt"))).scalar()
    return both.select(
        "hcpcs_cd",
        "F_pymt",
        "O_pymt",
        "F_svcs",
        "site_ratio",
        guarded_ratio(c("F_svcs"), largest).alias("relative_volume"),
        (highest * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(22,4)").alias("axis_max"),
    )


# --- Outlier explorer --------------------------------------------------------

# The columns of the explorer, in order.
_EXPLORER = [
    "npi",
    "display_name",
    "specialty",
    "state_abrvtn",
    "ruca_bucket",
    "is_participating",
    "provider_tier",
    "total_mdcr_pymt",
    "total_services",
    "drug_share",
    "is_drug_dependent",
]


def provider_outliers(dim_provider: DataFrame, mart: DataFrame, **filters) -> DataFrame:
    """Filtered providers with their drug shares; a provider may have several."""
    shares = mart.select("npi", "drug_share", "is_drug_dependent")
    return apply_filters(dim_provider, **filters).join(shares, "npi", "left").select(*_EXPLORER)


def outlier_explorer(
    dim_provider: DataFrame, mart: DataFrame, k: int = 100, **filters
) -> DataFrame:
    """The first ``k`` rows of ``provider_outliers`` by payment.

    A left join keeps every provider, so the first ``k`` joined rows belong to
    the first ``k`` providers: those are picked before the join, and the mart is
    reduced to them by a semi-join instead of being shuffled.
    """
    by_payment = [c("total_mdcr_pymt").desc_nulls_last(), c("npi")]
    leaders = apply_filters(dim_provider, **filters).orderBy(*by_payment).limit(k)
    theirs = mart.join(leaders.select("npi"), "npi", "left_semi")
    ties = [c("drug_share").desc_nulls_last(), c("is_drug_dependent").desc_nulls_last()]
    return provider_outliers(leaders, theirs).orderBy(*by_payment, *ties).limit(k)
