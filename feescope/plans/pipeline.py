"""The batch job: raw files to checked gold tables, one stage per table.

Every stage reads what the previous one wrote, so a lost executor or a rerun
repeats one stage only, and each mart scans just the fact columns it needs. The
fact is not cached: at full size it does not fit, and a cache would hide the
files from pruning and pushdown.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import dims, fact as facts, marts, quality, silver as silvers
from ..schemas import CLUSTERING, PARTITIONS, RANGE_CLUSTERED, SILVER
from ..sources import (
    CORRUPT,
    cluster_by,
    move_catalogs,
    publish_run,
    read_bronze,
    read_table,
    register_gold,
    run_root,
    sample,
    table_path,
    write_table,
)

FACT = "fact_provider_service"


@dataclass(frozen=True)
class Settings:
    """Thresholds and bands; the defaults are those of the published pipeline.

    Only the row band is open at its upper end, for more than one release year; the published band
    is ``quality.FACT_BAND``. ``drift_tol`` is absolute: with fractional services, which are truncated,
    stored and recomputed totals differ by more than a cent and the check fails unless it is raised.
    """

    source_year: int = silvers.SOURCE_YEAR
    run_ts: datetime | None = None
    sample_rows: int | None = None
    dedup: bool = False
    basket_size: int = 50
    dependent_share: float = 0.60
    tier_min_services: int = 25
    site_min_services: int = 1000
    row_band: quality.Band = quality.FACT_BAND_OPEN
    geo_band: quality.Band = quality.GEOGRAPHY_BAND
    drift_tol: float = quality.DRIFT_TOLERANCE


class Pipeline:
    """Stages over one root folder with ``silver`` and ``gold`` below it."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.spark = spark
        self.root = root
        self.settings = settings or Settings()
        self._writing: str | None = None  # root of a run that is not published yet
        self._raw: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the run in progress, or of the published one."""
        layer = "silver" if name == SILVER else "gold"
        return read_table(self.spark, self._writing or self.root, layer, name)

    def _save(self, df: DataFrame, name: str, rebalance: bool = True) -> None:
        layer = "silver" if name == SILVER else "gold"
        if name in RANGE_CLUSTERED:
            # A range exchange on (partition value, key): large values are split by the key itself.
            # What hardly compresses and follows from other columns stays out of it.
            if name == FACT:
                df = df.drop(*facts.DERIVED)
            df = cluster_by(df, [*PARTITIONS.get(name, ()), *CLUSTERING[name]])
            if name == FACT:
                df = facts.with_derived(df)
            rebalance = False
        write_table(
            df,
            table_path(self._writing or self.root, layer, name),
            partition_by=PARTITIONS.get(name, ()),
            sort_by=CLUSTERING.get(name, ()),
            rebalance=rebalance,
        )

    def build_silver(self, bronze: DataFrame) -> None:
        s = self.settings
        raw = sample(bronze, s.sample_rows) if s.sample_rows else bronze
        # Counted while the table is written, without another pass over the raw files.
        corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
        seen, country = Observation("raw"), F.col("Rndrng_Prvdr_Cntry")
        raw = raw.observe(
            seen,
            F.count(F.lit(1)).alias("n_raw"),
            F.count_if(corrupt).alias("n_corrupt"),
            F.count_if(~corrupt & F.coalesce(F.trim(country) != silvers.COUNTRY, F.lit(True))).alias("n_abroad"),
        ).drop(CORRUPT)
        if s.dedup:
            self._save(silvers.dedup_on_service_key(silvers.build_silver(raw, s.source_year, s.run_ts)), SILVER)
        else:
            typed = silvers.build_silver(raw, s.source_year, s.run_ts, together=PARTITIONS[SILVER])
            self._save(typed, SILVER, rebalance=False)
        self._raw = seen.get

    def build_dims(self) -> None:
        builders: dict[str, Callable[[DataFrame], DataFrame]] = {
            "dim_provider": dims.build_dim_provider,
            "dim_hcpcs": dims.build_dim_hcpcs,
            "dim_geography": dims.build_dim_geography,
        }
        for name, build in builders.items():
            self._save(build(self.table(SILVER)), name)

    def build_fact(self) -> None:
        self._save(facts.build_fact(self.table(SILVER)), FACT)

    def build_marts(self) -> None:
        s = self.settings
        fact, codes = self.table(FACT), self.table("dim_hcpcs")
        self._save(marts.geo_arbitrage(fact, s.basket_size, codes), "gold_hero_geo_arbitrage")
        self._save(marts.non_par_premium(fact), "gold_hero_non_par_premium")
        self._save(
            marts.jcode_concentration(fact, s.dependent_share), "gold_hero_jcode_concentration"
        )
        self._save(
            marts.credentials_markup(fact, codes, s.tier_min_services),
            "gold_hero_credentials_markup",
        )
        self._save(
            marts.site_neutral(fact, codes, s.site_min_services), "gold_hero_site_neutral"
        )

    def check(self) -> DataFrame:
        """The thirteen checks and the three foreign-key checks."""
        s = self.settings
        fact = self.table(FACT)
        tables = {name: self.table(name) for name in quality.KEYS}
        report = quality.run_checks(
            self.table(SILVER), None, tables, s.row_band, s.geo_band, s.drift_tol
        )
        report = report.unionByName(quality.foreign_key_checks(fact, tables, s.row_band))
        if self._raw:
            exact = not s.dedup
            report = report.unionByName(quality.raw_checks(self.table(SILVER), self._raw, exact))
        return report

    def register(self, db: str = "default") -> list[str]:
        return register_gold(self.spark, self.root, db)

    def run(self, bronze: DataFrame) -> list[tuple[str, bool]]:
        """All stages in order, into a folder of this run; published only if every check passes.

        A job that fails or dies leaves the tables of the run before as they were.
        """
        run = uuid.uuid4().hex
        self._writing = run_root(self.root, run)
        try:
            self.build_silver(bronze)
            self.build_dims()
            self.build_fact()
            self.build_marts()
            results = quality.assert_checks(self.check())
        finally:
            self._writing = None
        publish_run(self.spark, self.root, run)
        move_catalogs(self.spark, self.root)
        return results


def run_files(
    spark: SparkSession,
    raw_path: str,
    root: str,
    fmt: str = "json",
    settings: Settings | None = None,
    multi_line: bool = False,
) -> list[tuple[str, bool]]:
    """Run the whole job on raw files; records that do not parse fail its checks."""
    bronze = read_bronze(spark, raw_path, fmt, multi_line, keep_corrupt=True)
    return Pipeline(spark, root, settings).run(bronze)
