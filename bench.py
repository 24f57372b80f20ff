"""Headline timings on the given tables; prints one JSON line.

First the batch job stage by stage, from raw text records to written tables,
then the serving queries on the gold tables it wrote. Each serving query runs to
completion in a ``noop`` sink. The raw records are written once beforehand, so
that the job reads files as it would in production; that step is not timed. The
whole sequence runs twice and the second pass counts: in the first the JVM still
compiles most of the code.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from feescope.operators import lorenz, marts, quality, serving  # noqa: E402
from feescope.plans.pipeline import FACT, Pipeline, Settings  # noqa: E402
from feescope.schemas import SILVER  # noqa: E402
from feescope.session import build_session, shared_dir  # noqa: E402
from feescope.sources import read_bronze  # noqa: E402
from oracles.fixture import raw_records  # noqa: E402


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(
    spark: SparkSession,
    bronze: DataFrame,
    root: str,
    row_band: quality.Band,
    geo_band: quality.Band,
) -> dict[str, float]:
    """Seconds per stage and per serving query."""
    job = Pipeline(spark, root, Settings(row_band=row_band, geo_band=geo_band))
    timings: dict[str, float] = {}

    def timed(name: str, run: Callable[[], object]) -> None:
        start = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("stage_silver", lambda: job.build_silver(bronze))
    timed("stage_dims", job.build_dims)
    timed("stage_fact", job.build_fact)
    timed("stage_marts", job.build_marts)
    timed("stage_quality", lambda: quality.assert_checks(job.check()))

    fact, codes = job.table(FACT), job.table("dim_hcpcs")
    providers = job.table("dim_provider")
    geo, non_par = job.table("gold_hero_geo_arbitrage"), job.table("gold_hero_non_par_premium")
    jcode = job.table("gold_hero_jcode_concentration")
    markup, site = job.table("gold_hero_credentials_markup"), job.table("gold_hero_site_neutral")
    queries: dict[str, Callable[[], DataFrame]] = {
        "mart_geo_arbitrage": lambda: marts.geo_arbitrage(fact, dim_hcpcs=codes),
        "mart_non_par_premium": lambda: marts.non_par_premium(fact),
        "mart_jcode_concentration": lambda: marts.jcode_concentration(fact),
        "mart_credentials_markup": lambda: marts.credentials_markup(fact, codes),
        "mart_site_neutral": lambda: marts.site_neutral(fact, codes),
        "provider_drug": lambda: marts.provider_drug(fact),
        "top_codes": lambda: marts.top_codes(fact),
        "silver_checks": lambda: quality.silver_checks(job.table(SILVER)),
        "kpi_ribbon": lambda: serving.kpi_ribbon(providers),
        "kpi_ribbon_filtered": lambda: serving.kpi_ribbon(providers, states=["AX"], ruca="Urban"),
        "tornado": lambda: serving.tornado(serving.geo_by_state(geo)),
        "top_non_par": lambda: serving.top_non_par(non_par),
        "gini": lambda: lorenz.gini(jcode),
        "lorenz_curve": lambda: lorenz.lorenz_curve(jcode),
        "top_drug_codes": lambda: serving.top_drug_codes(codes),
        "markup_long": lambda: serving.markup_long(markup),
        "site_scatter": lambda: serving.site_scatter(site),
        "site_savings_total": lambda: serving.site_savings_total(site),
        "outlier_explorer": lambda: serving.outlier_explorer(providers, jcode),
    }
    for name, build in queries.items():
        timed(name, lambda build=build: consume(build()))
    return timings


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            # Sized to this data: at 128 MB a rebalanced write would be a single task.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = f"{shared_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    raw_path = f"{base}/raw"
    raw_records(spark, sf_dir).repartition(int(cpus)).write.json(raw_path)
    bronze = read_bronze(spark, raw_path, multi_line=False)

    bands = (1000, None), (1, 65)
    measure(spark, bronze, f"{base}/first", *bands)
    timings = measure(spark, bronze, f"{base}/second", *bands)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
