"""Registered queries, their DuckDB counterparts and the flagship query."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import cached_property, reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from feescope.functions import is_shared_e_and_m  # noqa: E402
from feescope.operators import (  # noqa: E402
    dims,
    fact as facts,
    lorenz,
    marts,
    quality,
    serving,
    silver as silvers,
)
from feescope.plans.pipeline import Pipeline, Settings  # noqa: E402
from feescope.schemas import ALL_TIERS, GOLD_SCHEMAS, KNOWN_TIERS, PARTITIONS, SILVER  # noqa: E402
from feescope.session import shared_dir  # noqa: E402
from feescope.sources import (  # noqa: E402
    CORRUPT,
    cached,
    cluster_by,
    gold_status,
    load_gold,
    read_bronze,
    read_table,
    register_gold,
    sample,
    table_path,
    write_table,
)
from oracles.fixture import RAW_FILES, raw_records, write_json_arrays  # noqa: E402
from oracles.sql import oracle_queries  # noqa: E402

try:  # the training-data operators are optional
    from feescope.llm import queries as llm_queries  # noqa: E402

    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("feescope.llm", "feescope.llm.queries", "corpus_pipeline"):
        raise
    llm_queries = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"
KEY = ["Rndrng_NPI", "HCPCS_Cd", "Place_Of_Srvc"]
FIXTURE_ROWS = (1000, None)
FIXTURE_STATES = (1, 65)


class Tables:
    """All layers over one folder of given tables, built lazily as one plan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return raw_records(self.spark, self.sf_dir)

    @cached_property
    def typed(self) -> DataFrame:
        return silvers.apply_casts(silvers.trim_to_null(self.raw))

    @cached_property
    def us(self) -> DataFrame:
        return silvers.keep_country(self.typed)

    @cached_property
    def silver(self) -> DataFrame:
        return silvers.build_silver(self.raw, run_ts=F.lit("2024-01-01 00:00:00"))

    @cached_property
    def silver_by_state(self) -> DataFrame:
        """Silver as the job writes it: rows of a state together."""
        run_ts = F.lit("2024-01-01 00:00:00")
        return silvers.build_silver(self.raw, run_ts=run_ts, together=PARTITIONS[SILVER])

    @cached_property
    def silver_data(self) -> DataFrame:
        """Silver without its load time."""
        return self.silver.drop("Ingested_At")

    @cached_property
    def fact(self) -> DataFrame:
        return facts.build_fact(self.silver)

    @cached_property
    def dim_provider(self) -> DataFrame:
        return dims.build_dim_provider(self.silver)

    @cached_property
    def dim_hcpcs(self) -> DataFrame:
        return dims.build_dim_hcpcs(self.silver)

    @cached_property
    def dim_geography(self) -> DataFrame:
        return dims.build_dim_geography(self.silver)

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in quality.KEYS}

    @cached_property
    def geo(self) -> DataFrame:
        return marts.geo_arbitrage(self.fact)

    @cached_property
    def non_par(self) -> DataFrame:
        return marts.non_par_premium(self.fact)

    @cached_property
    def jcode(self) -> DataFrame:
        return marts.jcode_concentration(self.fact)

    @cached_property
    def running(self) -> DataFrame:
        drug = marts.provider_drug(self.fact, with_codes=False).filter("drug_mdcr_pymt > 0")
        order = ["npi", "specialty", "state_abrvtn"]
        return lorenz.running_totals(drug, "drug_mdcr_pymt", order)

    @cached_property
    def credentials(self) -> DataFrame:
        return marts.credentials_markup(self.fact, self.dim_hcpcs)

    @cached_property
    def site(self) -> DataFrame:
        return marts.site_neutral(self.fact, self.dim_hcpcs)

    def scratch(self) -> str:
        """A fresh folder in the place that all executors share."""
        return f"{shared_dir(self.spark).rstrip('/')}/feescope-{uuid.uuid4().hex}"

    def pipeline(self) -> Pipeline:
        """The whole job, run from the raw records into a fresh root."""
        settings = Settings(row_band=FIXTURE_ROWS, geo_band=FIXTURE_STATES)
        job = Pipeline(self.spark, self.scratch(), settings)
        job.run(self.raw)
        return job


# --- sources and sinks: every one is a round trip ----------------------------


def _read_json_arrays(t: Tables) -> DataFrame:
    path = t.scratch()
    write_json_arrays(t.raw, path)
    return silvers.trim_to_null(read_bronze(t.spark, path, "json"))


def _read_json_lines(t: Tables) -> DataFrame:
    path = t.scratch()
    t.raw.write.options(**RAW_FILES).json(path)
    return silvers.trim_to_null(read_bronze(t.spark, path, "json"))


def _corrupt_count(t: Tables) -> DataFrame:
    """Every record of a provider whose number ends in 7 is cut short in the file."""
    path = t.scratch()
    text = F.to_json(F.struct(*t.raw.columns))
    cut = F.when(F.col("Rndrng_NPI").endswith("7"), F.substring(text, 1, 40)).otherwise(text)
    t.raw.select(cut.alias("value")).write.options(**RAW_FILES).text(path)
    back = read_bronze(t.spark, path, "json", keep_corrupt=True)
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("n_corrupt")
    )


def _read_csv(t: Tables) -> DataFrame:
    path = t.scratch()
    t.raw.write.option("header", True).option("escape", '"').options(**RAW_FILES).csv(path)
    return silvers.trim_to_null(read_bronze(t.spark, path, "csv"))


def _stored(t: Tables, layer: str, name: str, df: DataFrame, **layout) -> DataFrame:
    root = t.scratch()
    write_table(df, table_path(root, layer, name), **layout)
    return read_table(t.spark, root, layer, name)


def _loaded_gold(t: Tables) -> DataFrame:
    root = t.scratch()
    write_table(t.site, table_path(root, "gold", "gold_hero_site_neutral"))
    return load_gold(t.spark, root, "gold_hero_site_neutral")


def _registered(t: Tables) -> DataFrame:
    """Row counts through the catalog, in a database of its own that goes again."""
    job = t.pipeline()
    db = f"feescope_{uuid.uuid4().hex}"
    try:
        register_gold(t.spark, job.root, db)
        counts = [(name, t.spark.table(f"{db}.{name}").count()) for name in GOLD_SCHEMAS]
    finally:
        t.spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    return t.spark.createDataFrame(counts, "table_name string, n_rows long")


def _cached_fact(t: Tables) -> DataFrame:
    root = t.scratch()
    path = table_path(root, "gold", "gold_hero_geo_arbitrage")
    with cached(t.fact, marts.GEO_COLUMNS) as fact:
        write_table(marts.geo_arbitrage(fact), path, partition_by=["state_abrvtn"])
    return read_table(t.spark, root, "gold", "gold_hero_geo_arbitrage")


def _rerun(t: Tables) -> DataFrame:
    """Content hashes of two writes of the same build; as in the job, the mart reads the dimension that was written."""

    def build() -> dict[str, DataFrame]:
        codes = _stored(t, "gold", "dim_hcpcs", t.dim_hcpcs)
        site = marts.site_neutral(t.fact, codes)
        return {"dim_hcpcs": codes, "gold_hero_site_neutral": _stored(t, "gold", "gold_hero_site_neutral", site)}

    first, second = build(), build()

    def compare(name: str) -> DataFrame:
        once = quality.content_hash(first[name]).toDF("n_rows", "first_hash")
        again = quality.content_hash(second[name]).toDF("n_rows", "second_hash")
        return once.join(again, "n_rows", "full").select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.coalesce(F.col("first_hash") == F.col("second_hash"), F.lit(False)).alias("identical"),
        )

    return reduce(DataFrame.unionByName, map(compare, first))


def _tier_row_counts(t: Tables) -> DataFrame:
    """Rows per code and tier, pivoted on tier labels that need clean names."""
    wide = t.fact.groupBy("hcpcs_cd").pivot("provider_tier", ALL_TIERS).count().na.fill(0)
    return marts.sanitize_columns(wide.select("hcpcs_cd", *[F.col(f"`{name}`") for name in KNOWN_TIERS]))


def _check(name: str, report: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    return lambda t: report(t).filter(F.col("check_name") == name)


def _all_checks(t: Tables) -> DataFrame:
    return quality.run_checks(t.silver, t.fact, t.dims, FIXTURE_ROWS, FIXTURE_STATES)


_US_STATES = ["AX", "BX", "CX", "DX", "EX", "FX"]
_SILVER_CHECKS = {
    "d01_npi_not_null": "npi_not_null",
    "d02_hcpcs_not_null": "hcpcs_not_null",
    "d03_pos_in_domain": "pos_in_domain",
    "d04_ent_in_domain": "ent_in_domain",
    "d05_benes_min_11": "benes_min_11",
    "d06_ratios_nonneg": "ratios_nonneg",
    "d07_provider_tier_set": "provider_tier_set",
    "d13_decimal_drift": "decimal_drift_zero",
}

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # sources
    "s01_read_bronze": _read_json_arrays,
    "s01_read_bronze_csv": _read_csv,
    "s01_read_bronze_lines": _read_json_lines,
    "s01_corrupt_count": _corrupt_count,
    "s02_sample": lambda t: sample(t.raw).agg(F.count(F.lit(1)).alias("n_rows")),
    "s03_read_table": lambda t: _stored(
        t, "silver", SILVER, t.silver_by_state, partition_by=["Rndrng_Prvdr_State_Abrvtn"], rebalance=False
    ).drop("Ingested_At"),
    "s05_load_gold": _loaded_gold,
    "s06_gold_status": lambda t: gold_status(t.spark, t.pipeline().root),
    # sinks
    "k01_write_table": lambda t: _stored(t, "gold", "dim_provider", t.dim_provider),
    "k02_partitioned_write": lambda t: _stored(
        t,
        "gold",
        "fact_provider_service",
        t.fact,
        partition_by=["state_abrvtn"],
        sort_by=["hcpcs_cd", "specialty"],
    ),
    "k03_cluster_by": lambda t: _stored(
        t, "gold", "fact_provider_service", cluster_by(t.fact, ["hcpcs_cd", "specialty"], 8)
    ),
    "k04_register_gold": _registered,
    "k05_cached_fact": _cached_fact,
    # projections, filters, expressions
    "p01_trim_null": lambda t: silvers.trim_to_null(t.raw),
    "p02_casts": lambda t: t.typed.select(
        *KEY,
        "Rndrng_Prvdr_Cntry",
        *["Tot_Benes", "Tot_Srvcs", "Tot_Bene_Day_Srvcs", "Avg_Sbmtd_Chrg"],
        *["Avg_Mdcr_Alowd_Amt", "Avg_Mdcr_Pymt_Amt", "Avg_Mdcr_Stdzd_Amt"],
    ),
    "p03_keep_country": lambda t: t.us.select(*KEY, "Rndrng_Prvdr_Cntry"),
    "p04_service_key": lambda t: silvers.with_key(t.us).select(*KEY, "service_sk"),
    "p05_money_totals": lambda t: silvers.with_totals(t.us).select(
        *KEY, "Tot_Sbmtd_Chrg", "Tot_Mdcr_Alowd_Amt", "Tot_Mdcr_Pymt_Amt", "Tot_Mdcr_Stdzd_Amt"
    ),
    "p06_geo_premium": lambda t: t.us.select(*KEY, silvers.geo_premium().alias("Geo_Premium")),
    "p07_patient_exposure": lambda t: t.us.select(
        *KEY, silvers.patient_exposure().alias("Patient_Exposure")
    ),
    "p08_markup_ratio": lambda t: silvers.with_ratios(t.us).select(*KEY, "Markup_Ratio"),
    "p09_payment_rate": lambda t: silvers.with_ratios(t.us).select(*KEY, "Mdcr_Pymt_Rate"),
    "p10_geo_adj_factor": lambda t: silvers.with_ratios(t.us).select(*KEY, "Geo_Adj_Factor"),
    "p11_flags": lambda t: silvers.with_flags(t.us).select(
        *KEY, "Is_Drug", "Is_Facility", "Is_Participating", "Is_Org"
    ),
    "p12_rural": lambda t: silvers.with_rurality(t.us).select(*KEY, "RUCA_Int", "Is_Rural"),
    "p13_ruca_bucket": lambda t: silvers.with_rurality(t.us).select(*KEY, "RUCA_Bucket"),
    "p14_provider_tier": lambda t: silvers.with_tier(t.us).select(
        *KEY, "Rndrng_Prvdr_Crdntls", "Provider_Tier"
    ),
    "p15_lineage": lambda t: silvers.with_lineage(
        t.us, run_ts=F.lit("2024-01-01 00:00:00")
    ).select(
        *KEY,
        "Source_Year",
        F.date_format("Ingested_At", "yyyy-MM-dd HH:mm:ss").alias("Ingested_At"),
    ),
    "p16_silver": lambda t: t.silver_data,
    "p17_fact": lambda t: t.fact,
    "p18_display_name": lambda t: t.dim_provider.select(
        "npi", "is_org", "first_name", "last_org_name", "display_name"
    ),
    "p19_hcpcs_family": lambda t: t.dim_hcpcs.groupBy("hcpcs_family").agg(
        F.count(F.lit(1)).alias("n_codes")
    ),
    "p20_sanitize_columns": _tier_row_counts,
    "p21_shared_e_and_m": lambda t: t.dim_hcpcs.select(
        "hcpcs_cd", is_shared_e_and_m(F.col("hcpcs_cd")).alias("is_shared_e_and_m")
    ),
    "p22_renamed_aggregates": lambda t: t.dim_geography.select("state_abrvtn", "n_providers"),
    "p23_filters": lambda t: serving.apply_filters(
        t.dim_provider,
        states=_US_STATES[:5],
        specialties=[f"Specialty {i}" for i in range(1, 15)],
        ruca="Urban",
    ),
    "p24_drop_null": lambda t: serving.drop_null(
        t.silver, ["Geo_Premium", "Rndrng_Prvdr_RUCA"]
    ).select(*KEY, "Geo_Premium"),
    # aggregations and marts
    "a01_dim_provider": lambda t: t.dim_provider,
    "a02_dim_hcpcs": lambda t: t.dim_hcpcs,
    "a03_dim_geography": lambda t: t.dim_geography,
    "a04_top_codes": lambda t: marts.top_codes(t.fact),
    "a05_geo_arbitrage": lambda t: t.geo,
    "a06_participation_exposure": lambda t: marts.participation_exposure(t.fact),
    "a07_non_par_premium": lambda t: t.non_par,
    "a08_provider_drug": lambda t: marts.provider_drug(t.fact),
    "a09_jcode_concentration": lambda t: t.jcode,
    "a10_lorenz_totals": lambda t: t.running.agg(
        F.max("n_rows").alias("n_rows"), F.max("sum_value").alias("sum_value")
    ),
    "a11_tier_markup": lambda t: marts.tier_markup(t.fact),
    "a12_credentials_markup": lambda t: t.credentials,
    "a13_site_grain": lambda t: marts.site_grain(t.fact),
    "a14_site_neutral": lambda t: t.site,
    "a15_kpi_ribbon": lambda t: serving.kpi_ribbon(t.dim_provider),
    "a15_kpi_ribbon_filtered": lambda t: serving.kpi_ribbon(
        t.dim_provider, states=_US_STATES[:4], ruca="Urban"
    ),
    "a16_geo_by_state": lambda t: serving.geo_by_state(t.geo),
    "a17_gini": lambda t: lorenz.gini(t.jcode),
    "a17_gini_from_origin": lambda t: lorenz.gini(t.jcode, from_origin=True),
    "a18_site_savings_total": lambda t: serving.site_savings_total(t.site),
    "a19_site_scatter": lambda t: serving.site_scatter(t.site),
    "a20_state_options": lambda t: serving.filter_options(t.dim_provider, "state_abrvtn"),
    "a20_specialty_options": lambda t: serving.filter_options(t.dim_provider, "specialty"),
    # joins
    "j01_markup_described": lambda t: t.credentials.select(
        "hcpcs_cd", "is_shared_e_and_m", "hcpcs_desc"
    ),
    "j02_site_described": lambda t: t.site.select("hcpcs_cd", "hcpcs_desc", "is_drug"),
    "j03_outlier_join": lambda t: serving.provider_outliers(t.dim_provider, t.jcode),
    "j04_basket_rows": lambda t: marts.basket_rows(t.fact).select("service_sk", "hcpcs_cd"),
    "j05_scalar_attach": lambda t: t.running.select(
        "npi", "specialty", "state_abrvtn", "n_rows", "sum_value"
    ),
    # windows
    "w01_row_number": lambda t: t.running.select(
        "npi", "specialty", "state_abrvtn", "drug_mdcr_pymt", "rn"
    ),
    "w02_running_sum": lambda t: t.running.select(
        "npi", "specialty", "state_abrvtn", "drug_mdcr_pymt", "cum_value"
    ),
    "w03_cumulative_shares": lambda t: t.jcode.select(
        "npi", "specialty", "state_abrvtn", "cum_share_providers", "cum_share_drug"
    ),
    # sorts, top-k, reshapes
    "t01_top_codes": lambda t: marts.top_codes_of(t.dim_hcpcs),
    "t02_tornado": lambda t: serving.tornado(serving.geo_by_state(t.geo)),
    "t03_top_non_par": lambda t: serving.top_non_par(t.non_par),
    "t04_top_drug_codes": lambda t: serving.top_drug_codes(t.dim_hcpcs),
    "t05_outlier_explorer": lambda t: serving.outlier_explorer(t.dim_provider, t.jcode),
    "t05_outlier_explorer_filtered": lambda t: serving.outlier_explorer(
        t.dim_provider, t.jcode, states=_US_STATES, ruca="Urban"
    ),
    "t06_lorenz_curve": lambda t: lorenz.lorenz_curve(t.jcode),
    "t07_unpivot_markup": lambda t: serving.markup_long(t.credentials),
    # quality
    **{
        key: _check(name, lambda t: quality.silver_checks(t.silver))
        for key, name in _SILVER_CHECKS.items()
    },
    "d08_fact_row_count_band": lambda t: quality.row_count_check(
        t.fact, "fact_row_count_band", FIXTURE_ROWS
    ),
    "d09_dim_provider_unique": lambda t: quality.unique_check(
        t.dim_provider, "dim_provider_unique", "npi"
    ),
    "d10_dim_hcpcs_unique": lambda t: quality.unique_check(
        t.dim_hcpcs, "dim_hcpcs_unique", "hcpcs_cd"
    ),
    "d11_dim_geo_unique": lambda t: quality.unique_check(
        t.dim_geography, "dim_geo_unique", "state_abrvtn"
    ),
    "d12_dim_geo_reasonable": lambda t: quality.row_count_check(
        t.dim_geography, "dim_geo_reasonable", FIXTURE_STATES
    ),
    "d14_gate": lambda t: quality.gate(_all_checks(t)),
    "d15_idempotent_rerun": _rerun,
    "d16_fk_integrity": lambda t: quality.foreign_key_checks(t.fact, t.dims),
    # opt-in
    "x03_dedup_service_key": lambda t: silvers.dedup_on_service_key(t.silver).select(
        "service_sk", *KEY
    ),
    "x06_duplicate_probes": lambda t: quality.duplicate_probes(t.silver, t.jcode),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: site-neutral savings per procedure code."""
    return Tables(spark, SMOKE_DIR).site


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator over the given tables."""

    def bind(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    found = {key: bind(build) for key, build in _QUERIES.items()}
    if llm_queries:
        found |= {**llm_queries.queries(), "pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per key."""
    found = oracle_queries()
    if llm_queries:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
