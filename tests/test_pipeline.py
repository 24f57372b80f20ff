from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feescope.operators import quality
from feescope.plans.pipeline import Pipeline, Settings, run_files
from feescope.schemas import GOLD_SCHEMAS, SILVER
from feescope.sources import gold_is_empty
from oracles.fixture import write_json_arrays

SETTINGS = Settings(run_ts=datetime(2024, 1, 1), row_band=(1, 10**6), geo_band=(1, 65))


@pytest.fixture(scope="module")
def records(spark):
    return entry.Tables(spark, entry.SMOKE_DIR).raw


def test_whole_job_from_files_and_rerun(spark, records, tmp_path):
    write_json_arrays(records, f"{tmp_path}/raw")
    root = f"{tmp_path}/lake"
    results = run_files(spark, f"{tmp_path}/raw", root, settings=SETTINGS)
    assert len(results) == 18 and all(ok for _, ok in results)
    job = Pipeline(spark, root, SETTINGS)
    names = [SILVER, *GOLD_SCHEMAS]

    def hashes():
        return {n: tuple(quality.content_hash(job.table(n)).first()) for n in names}

    first = hashes()
    assert first[SILVER][0] == 2255 and first["dim_provider"][0] == 9
    assert not gold_is_empty(spark, root)
    # A rerun over the same root replaces every table with the same content.
    run_files(spark, f"{tmp_path}/raw", root, settings=SETTINGS)
    assert hashes() == first


def test_only_the_load_time_differs_between_runs(spark, records, tmp_path):
    hashes = []
    for run in "ab":
        job = Pipeline(spark, f"{tmp_path}/{run}", Settings())
        job.build_silver(records)
        silver = job.table(SILVER)
        hashes.append(
            [quality.content_hash(silver, x).first() for x in ([], ["Ingested_At"])]
        )
    assert hashes[0][0] != hashes[1][0] and hashes[0][1] == hashes[1][1]


def test_registered_tables_stay_valid_and_current(spark, records, tmp_path):
    job = Pipeline(spark, f"{tmp_path}/lake", SETTINGS)
    job.run(records)
    job.register("moving")
    try:
        counts = [spark.table("moving.fact_provider_service").count()]
        for share in (0.5, 0.9):
            Pipeline(spark, f"{tmp_path}/lake", replace(SETTINGS, geo_band=(0, 65))).run(records.filter(F.col("Rndrng_NPI").cast("long") % 10 < 10 * share))
            counts.append(spark.table("moving.fact_provider_service").count())
            assert counts[-1] == job.table("fact_provider_service").count()
            assert spark.table("moving.dim_provider").count() == job.table("dim_provider").count()
        assert counts[1] < counts[2] < counts[0]
        spark.sql("DROP TABLE moving.dim_provider")
        job.run(records)
        assert not spark.catalog.tableExists("moving.dim_provider")  # what was dropped does not come back
    finally:
        spark.sql("DROP DATABASE moving CASCADE")


def test_failed_check_stops_the_job(spark, records, tmp_path):
    strict = Settings(row_band=(10**6, 10**7), geo_band=(1, 65))
    with pytest.raises(quality.DataQualityError, match="fact_row_count_band"):
        Pipeline(spark, str(tmp_path), strict).run(records)


def test_a_failed_run_leaves_the_old_tables(spark, records, tmp_path):
    root = f"{tmp_path}/lake"
    Pipeline(spark, root, SETTINGS).run(records)
    job = Pipeline(spark, root, SETTINGS)
    before = quality.content_hash(job.table("fact_provider_service")).first()
    strict = Settings(row_band=(10**6, None), geo_band=(1, 65))
    with pytest.raises(quality.DataQualityError, match="fact_row_count_band"):
        Pipeline(spark, root, strict).run(records.limit(300))
    with pytest.raises(Exception):  # dies in the first stage
        Pipeline(spark, root, SETTINGS).run(records.withColumn("HCPCS_Cd", F.raise_error(F.lit("lost"))))
    assert quality.content_hash(job.table("fact_provider_service")).first() == before
    assert not gold_is_empty(spark, root)


def test_corrupt_and_lost_records_fail_the_gate(spark, records, tmp_path):
    records.limit(200).write.json(f"{tmp_path}/raw")
    with open(f"{tmp_path}/raw/cut.json", "w") as extra:
        extra.write('{"Rndrng_NPI": "1", "HCPC')
    with pytest.raises(quality.DataQualityError, match="raw_corrupt_records"):
        run_files(spark, f"{tmp_path}/raw", f"{tmp_path}/lake", settings=SETTINGS)
    raw = {"n_raw": 10, "n_corrupt": 0, "n_abroad": 2}
    kept = {r.check_name: r.passed for r in quality.raw_checks(spark.range(7), raw).collect()}
    assert kept == {"raw_corrupt_records": True, "raw_records_kept": False}


def test_pretty_printed_files(spark, records, tmp_path):
    import json

    rows = [r.asDict() for r in records.limit(150).collect()]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps(rows, indent=1))
    results = run_files(spark, f"{tmp_path}/raw", f"{tmp_path}/lake", settings=SETTINGS, multi_line=True)
    assert dict(results)["raw_records_kept"]


def test_a_state_over_several_files_is_clustered_by_code(spark, records, tmp_path):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        job = Pipeline(spark, f"{tmp_path}/lake", replace(SETTINGS, geo_band=(0, 65)))
        job.run(records.withColumn("Rndrng_Prvdr_State_Abrvtn", F.lit("AX")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fact = job.table("fact_provider_service")
    files = fact.groupBy(F.input_file_name()).agg(F.min("hcpcs_cd").alias("lo"), F.max("hcpcs_cd").alias("hi")).collect()
    code = sorted(r.lo for r in files)[len(files) // 2]
    assert len(files) >= 4 and sum(r.lo <= code <= r.hi for r in files) <= 2


def test_sample_mode(spark, records, tmp_path):
    settings = Settings(
        sample_rows=1000,
        dedup=True,
        row_band=quality.FACT_BAND_SAMPLE,
        geo_band=quality.GEOGRAPHY_BAND_SAMPLE,
    )
    job = Pipeline(spark, str(tmp_path), settings)
    job.run(records)
    assert 0 < job.table("fact_provider_service").count() <= 1000


def test_same_content_with_ansi_on_and_off(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    seen = []
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            t = entry.Tables(spark, entry.SMOKE_DIR)
            layers = [t.silver, t.dim_provider, t.geo, t.non_par, t.jcode, t.credentials, t.site]
            seen.append([tuple(quality.content_hash(df).first()) for df in layers])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert seen[0] == seen[1] and all(n for n, _ in seen[0])


def test_unpivot_returns_what_was_pivoted(spark):
    from feescope.operators import marts, serving

    t = entry.Tables(spark, "/root/testdata/sf0.01")
    long = serving.markup_long(t.credentials).select(
        "hcpcs_cd", "provider_tier", "markup_ratio", "services"
    )
    tiers = marts.tier_markup(t.fact).filter("is_shared_e_and_m AND wavg_markup_ratio IS NOT NULL")
    source = tiers.select("hcpcs_cd", "provider_tier", "wavg_markup_ratio", "total_services")
    rows = sorted(map(tuple, long.collect()))
    assert rows and rows == sorted(map(tuple, source.collect()))


def test_rerun_reads_the_written_dimension(spark, monkeypatch):
    """The dimension is built once a build, not once more inside the mart."""
    built = []
    whole = entry.marts.site_neutral
    monkeypatch.setattr(entry.marts, "site_neutral", lambda fact, codes: built.append(codes) or whole(fact, codes))
    rows = entry.queries()["d15_idempotent_rerun"](spark, entry.SMOKE_DIR).collect()
    assert sorted((r.table_name, r.identical) for r in rows) == [("dim_hcpcs", True), ("gold_hero_site_neutral", True)]
    assert len(built) == 2 and all("Aggregate" not in codes._jdf.queryExecution().analyzed().toString() for codes in built)


def test_fact_is_written_as_silver_has_it(spark, records, tmp_path):
    from feescope.operators.fact import build_fact

    job = Pipeline(spark, str(tmp_path), SETTINGS)
    job.build_silver(records)
    job.build_fact()
    assert quality.content_hash(job.table("fact_provider_service")).collect() == quality.content_hash(build_fact(job.table(SILVER))).collect()
