from __future__ import annotations

import gzip
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from feescope.schemas import GOLD_SCHEMAS, RAW_COLUMNS
from feescope.sources import (
    ContractError,
    cached,
    cluster_by,
    current_root,
    gold_is_empty,
    gold_status,
    load_gold,
    publish_run,
    read_bronze,
    read_table,
    register_gold,
    remove_abandoned,
    run_root,
    sample,
    table_path,
    write_table,
)
from oracles.fixture import write_json_arrays


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps(
            [
                {"Rndrng_NPI": 1234567890, "Tot_Benes": 12.5, "HCPCS_Cd": True, "surplus": 1},
                {"Rndrng_NPI": "2", "HCPCS_Cd": None},
            ],
            indent=2,
        )
    )
    (tmp_path / "b.json").write_text("[]")
    df = read_bronze(spark, f"{tmp_path}/*.json", multi_line=True)
    assert df.columns == RAW_COLUMNS and {t for _, t in df.dtypes} == {"string"}
    rows = {r.Rndrng_NPI: r for r in df.collect()}
    assert rows["1234567890"].Tot_Benes == "12.5" and rows["1234567890"].HCPCS_Cd == "true"
    assert rows["2"].HCPCS_Cd is None and rows["2"].Tot_Srvcs is None


def test_json_lines_and_array_writer(spark, raw, tmp_path):
    df = raw(*[{"Rndrng_NPI": str(i)} for i in range(50)]).repartition(4)
    df.write.json(f"{tmp_path}/lines")
    write_json_arrays(df, f"{tmp_path}/arrays")
    write_json_arrays(df.limit(0), f"{tmp_path}/none")
    want = sorted(map(tuple, df.collect()))
    for multi_line in (False, True):
        for layout in ("lines", "arrays"):
            back = read_bronze(spark, f"{tmp_path}/{layout}", multi_line=multi_line)
            assert sorted(map(tuple, back.collect())) == want, (layout, multi_line)
        assert read_bronze(spark, f"{tmp_path}/none", multi_line=multi_line).count() == 0


def test_several_records_on_a_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Rndrng_NPI": "1", "x": [1, 2]}, {"Rndrng_NPI": "2"},\n {"Rndrng_NPI": "]3"}]\n')
    for multi_line in (False, True):
        rows = read_bronze(spark, str(tmp_path), multi_line=multi_line).collect()
        assert sorted(r.Rndrng_NPI for r in rows) == ["1", "2", "]3"]


def test_malformed_records_are_counted_or_fail(spark, tmp_path):
    good = [json.dumps({"Rndrng_NPI": str(i), "HCPCS_Cd": "99213"}) for i in range(5)]
    (tmp_path / "cut.json").write_text("[" + ",\n".join(good)[:-20])
    for multi_line, corrupt, kept in ((False, 1, 4), (True, 1, 4)):
        rows = read_bronze(spark, str(tmp_path), multi_line=multi_line, keep_corrupt=True).collect()
        bad = [r for r in rows if r._corrupt_record is not None]
        assert len(bad) == corrupt and len(rows) - len(bad) == kept
        with pytest.raises(Exception, match="malformed raw record"):
            read_bronze(spark, str(tmp_path), multi_line=multi_line).collect()
    (tmp_path / "cut.json").write_text('{\n "Rndrng_NPI": "1"\n}\n17\n')
    assert read_bronze(spark, str(tmp_path), keep_corrupt=True).filter("_corrupt_record IS NOT NULL").count() >= 2


@pytest.mark.parametrize(
    "text",
    [
        '[{1},{2}][{3},{4}]',
        '[[{1},{2}],[{3}],{4}]',
        '[{1},{2}]\n[{3},{4}]\n',
        '[{1}] [{2}],[{3},{4}]',
        '{1}{2}\n{3},{4}',
        '[\n{1},\n{2}\n][\n{3},\n{4}\n]\n',
        '[{1},{2}][{3},{4}',
        '[{1},{2},7]\n{3}\n{4}',
        '[{1},null,{2}]\n{3}\n{4}',
        '[{1},{2}],"x"\n{3}\n{4}',
        'junk\n{1}\n{2}\n{3}\nmore\n{4}',
    ],
)
def test_no_record_is_lost_in_silence(spark, tmp_path, text):
    """Joined and nested arrays: every record is read, or its line is a corrupt row."""
    for n, note in ((1, "a"), (2, "b][{"), (3, "}][{c"), (4, "")):
        text = text.replace(f"{{{n}}}", json.dumps({"Rndrng_NPI": str(n), "HCPCS_Desc": note}))
    text = text.replace("{4", '{"Rndrng_NPI": "4"')
    (tmp_path / "a.json").write_text(text)
    for multi_line in (False, True):
        rows = read_bronze(spark, str(tmp_path), multi_line=multi_line, keep_corrupt=True).collect()
        found = {r.Rndrng_NPI: r.HCPCS_Desc for r in rows if r._corrupt_record is None}
        bad = " ".join(r._corrupt_record for r in rows if r._corrupt_record is not None)
        for n in "1234":
            assert n in found or f'"Rndrng_NPI": "{n}"' in bad, (multi_line, n, rows)
        assert len(found) == sum(r._corrupt_record is None for r in rows)
        assert all(found[n] == note for n, note in (("1", "a"), ("2", "b][{"), ("3", "}][{c")) if n in found)


def test_joined_arrays_on_a_line_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Rndrng_NPI":"1"},{"Rndrng_NPI":"2"}][{"Rndrng_NPI":"3"},{"Rndrng_NPI":"4"}]\n[[{"Rndrng_NPI":"5"}]]')
    for multi_line in (False, True):
        rows = read_bronze(spark, str(tmp_path), multi_line=multi_line, keep_corrupt=True).collect()
        assert sorted((r.Rndrng_NPI, r._corrupt_record) for r in rows) == [(str(n), None) for n in range(1, 6)]


def test_records_that_span_lines_split(spark, tmp_path):
    """Pretty-printed and one-line arrays over many tasks, in splits that cut records anywhere."""
    records = []
    for n in range(300):
        record = {"Rndrng_NPI": str(n), "HCPCS_Desc": f"text {n} é", "Tot_Benes": n}
        if n % 7 == 0:
            record |= {"surplus": {"a": {"b": [1, {"c": 2}]}}, "more": [{"c": "inner"}, {}]}
        if n % 11 == 0:
            record["HCPCS_Desc"] = 'a } b { c }, { "Rndrng_NPI": 1 }] [ \\ " {'
        if n % 13 == 0:
            record = {"surplus": {}, "Rndrng_Zip": None}
        records.append(record)
    want = sorted((str(r.get("Rndrng_NPI")), str(r.get("HCPCS_Desc")), str(r.get("Tot_Benes"))) for r in records)
    for name, text in (
        ("pretty", json.dumps(records, indent=2, ensure_ascii=False)),
        ("line", json.dumps(records)),
        ("lines", "\n".join(map(json.dumps, records))),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 1500, 40_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            for name in ("pretty", "line", "lines"):
                back = read_bronze(spark, f"{tmp_path}/{name}", multi_line=True, keep_corrupt=True)
                if size < 2000:
                    assert back.rdd.getNumPartitions() > 10
                found = sorted((str(r.Rndrng_NPI), str(r.HCPCS_Desc), str(r.Tot_Benes)) for r in back.collect())
                assert found == want, (size, name)
                assert back.filter("_corrupt_record IS NOT NULL").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_broken_records_that_span_lines_are_counted(spark, tmp_path):
    good = [json.dumps({"Rndrng_NPI": str(n), "Tot_Benes": "1"}, indent=1) for n in range(6)]
    (tmp_path / "a.json").write_text("[\n" + ",\n".join([*good[:3], '{\n "Rndrng_NPI": "x",\n "Tot', *good[3:]]) + "\n]\n")
    (tmp_path / "b.json").write_text("[" + good[0] + "," + good[1][:-2])
    rows = read_bronze(spark, str(tmp_path), multi_line=True, keep_corrupt=True).collect()
    assert sorted(r.Rndrng_NPI for r in rows if r._corrupt_record is None) == ["0", "0", "1", "2", "3", "4", "5"]
    assert len([r for r in rows if r._corrupt_record is not None]) == 2


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Rndrng_NPI,HCPCS_Cd\n1,99213\n")
    (tmp_path / "b.csv").write_text("HCPCS_Cd,Rndrng_NPI\n99214,2\n")
    for columns in (RAW_COLUMNS, ["Rndrng_NPI"]):
        with pytest.raises(Exception, match="header|Header"):
            read_bronze(spark, str(tmp_path), "csv").select(*columns).collect()
    (tmp_path / "b.csv").write_text('Rndrng_NPI,HCPCS_Cd\n2,"99\n214"\n')
    rows = read_bronze(spark, str(tmp_path), "csv", multi_line=True).collect()
    assert sorted((r.Rndrng_NPI, r.HCPCS_Cd) for r in rows) == [("1", "99213"), ("2", "99\n214")]


def test_csv_is_matched_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('HCPCS_Cd,extra,Rndrng_NPI\n99213,x,"1 ""a"", b"\n')
    df = read_bronze(spark, str(tmp_path / "a.csv"), "csv")
    assert df.columns == RAW_COLUMNS
    row = df.first()
    assert (row.Rndrng_NPI, row.HCPCS_Cd, row.Tot_Benes) == ('1 "a", b', "99213", None)
    with pytest.raises(ValueError, match="xml"):
        read_bronze(spark, str(tmp_path), "xml")


def test_sample(spark):
    assert sample(spark.range(5000)).count() == 1000
    assert sample(spark.range(5), 10).count() == 5


def test_table_path():
    assert table_path("s3://lake/", "gold", "dim_hcpcs") == "s3://lake/gold/dim_hcpcs"


@pytest.fixture
def geo(gold_rows):
    return gold_rows(
        "gold_hero_geo_arbitrage",
        {"state_abrvtn": "01", "ruca_bucket": "Urban", "total_services": 1},
        {"state_abrvtn": "AX", "ruca_bucket": "Urban", "total_services": 2},
        {"state_abrvtn": None, "ruca_bucket": "Unknown", "total_services": 3},
    )


def test_partitioned_table_keeps_types_order_and_nulls(spark, geo, tmp_path):
    name = "gold_hero_geo_arbitrage"
    write_table(geo, table_path(str(tmp_path), "gold", name), ["state_abrvtn"], ["ruca_bucket"])
    back = read_table(spark, str(tmp_path), "gold", name)
    assert back.schema == GOLD_SCHEMAS[name]
    assert sorted(back.collect(), key=str) == sorted(geo.collect(), key=str)


def test_overwrite_replaces_rows_and_schema(spark, tmp_path):
    path = f"{tmp_path}/gold/other"
    write_table(spark.range(5), path)
    write_table(spark.range(3).withColumn("x", F.lit("y")), path)
    back = read_table(spark, str(tmp_path), "gold", "other")
    assert back.columns == ["id", "x"] and back.count() == 3
    with pytest.raises(ValueError, match="would replace"):
        write_table(back.filter("id > 0"), path + "/")
    with pytest.raises(ValueError, match="would replace"):
        write_table(spark.range(2).join(back, "id"), path)
    assert back.count() == 3


def test_load_gold_falls_back_only_if_the_path_is_missing(spark, geo, tmp_path):
    root, name = str(tmp_path), "gold_hero_geo_arbitrage"
    missing = load_gold(spark, root, name)
    assert missing.schema == GOLD_SCHEMAS[name] and missing.isEmpty()
    write_table(geo.drop("total_stdzd").withColumn("odd", F.lit(1)), table_path(root, "gold", name))
    with pytest.raises(ContractError, match="total_stdzd.*odd"):
        load_gold(spark, root, name)
    retyped = geo.withColumn("total_services", F.lit("many"))
    write_table(retyped, table_path(root, "gold", name))
    with pytest.raises(ContractError, match="types.*total_services"):
        load_gold(spark, root, name)


def test_gold_status(spark, geo, tmp_path):
    root = str(tmp_path)
    assert gold_is_empty(spark, root)
    write_table(geo.limit(0), table_path(root, "gold", "gold_hero_geo_arbitrage"))
    assert gold_is_empty(spark, root)
    write_table(geo, table_path(root, "gold", "gold_hero_geo_arbitrage"))
    assert not gold_is_empty(spark, root)
    empty = {r.table_name: r.is_empty for r in gold_status(spark, root).collect()}
    assert len(empty) == 6 and [n for n, e in empty.items() if not e] == ["gold_hero_geo_arbitrage"]


def test_hot_partition_value_is_split_over_files(spark, tmp_path):
    """One state with most rows must not become one task."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 < 8, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 40)).alias("s"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_table(df, f"{tmp_path}/t", ["s"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    hot = list((tmp_path / "t" / "s=HOT").glob("*.parquet"))
    assert len(hot) > 3
    assert spark.read.parquet(f"{tmp_path}/t").count() == 200_000


def test_cluster_by_narrows_files_and_splits_a_hot_key(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id") % 1000).cast("int").alias("k"), "id"
    )
    clustered = cluster_by(df, ["k"], 8)
    sizes = clustered.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 12_000
    write_table(clustered, f"{tmp_path}/c")
    files = spark.read.parquet(f"{tmp_path}/c").groupBy(F.input_file_name()).agg(F.min("k"), F.max("k")).collect()
    assert sum(lo <= 10 <= hi for _, lo, hi in files) == 1
    assert spark.read.parquet(f"{tmp_path}/c").count() == 40_000


def test_cluster_by_gives_a_larger_table_more_files(spark):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 1000).cast("int").alias("k"), "id")
    clustered = cluster_by(df, ["k"], 2, rows_per_file=4_000)
    sizes = [r["count"] for r in clustered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 8_000 and sum(sizes) == 40_000


def test_raw_text_is_compressed_in_files_of_bounded_rows(spark, raw, tmp_path):
    df = raw(*[{"Rndrng_NPI": str(i)} for i in range(50)]).coalesce(1)
    write_json_arrays(df, f"{tmp_path}/arrays", array_rows=20)
    files = list((tmp_path / "arrays").glob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".gz") for f in files)
    for f in files:
        assert isinstance(json.loads(gzip.decompress(f.read_bytes())), list)
    for multi_line in (False, True):
        back = read_bronze(spark, f"{tmp_path}/arrays", multi_line=multi_line)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("key", ["s01_read_bronze", "s01_read_bronze_lines", "s01_corrupt_count", "s01_read_bronze_csv"])
def test_round_trips_of_raw_text_write_compressed(spark, tmp_path, monkeypatch, key):
    monkeypatch.setattr(entry.Tables, "scratch", lambda t: f"{tmp_path}/raw")
    back = entry.queries()[key](spark, entry.SMOKE_DIR)
    assert back.count() == (1 if key.endswith("count") else 2493)
    parts = list((tmp_path / "raw").glob("part-*"))
    assert parts and all(p.name.endswith(".gz") for p in parts)


def test_register_gold(spark, gold_rows, geo, tmp_path):
    root = str(tmp_path)
    for name in GOLD_SCHEMAS:
        partitions = ["state_abrvtn"] if "state_abrvtn" in GOLD_SCHEMAS[name].fieldNames() else []
        if name == "gold_hero_geo_arbitrage":
            df = geo
        else:
            df = gold_rows(name, {"state_abrvtn": "AX"} if partitions else {})
        write_table(df, table_path(root, "gold", name), partitions[:1] if name.startswith("fact") or df is geo else ())
    for _ in range(2):
        assert len(register_gold(spark, root)) == 9
    assert spark.table("default.gold_hero_geo_arbitrage").count() == 3
    assert spark.table("default.fact_provider_service").filter("state_abrvtn = 'AX'").count() == 1
    assert spark.table("default.dim_provider").count() == 1
    for name in GOLD_SCHEMAS:
        spark.sql(f"DROP TABLE default.{name}")


def test_two_jobs_publish_at_once(spark, tmp_path):
    """Neither job loses its folder, the later one wins, and a run still being written survives both."""
    root = str(tmp_path)

    def write(run):
        spark.range(3).write.parquet(f"{run_root(root, run)}/gold/x")
    for run in ("old", "first", "second", "writing"):
        write(run)
    assert current_root(spark, root) == root
    publish_run(spark, root, "old")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda run: publish_run(spark, root, run), ["first", "second"]))
    last = current_root(spark, root).rsplit("/", 1)[-1]
    assert last in ("first", "second")
    left = {p.name for p in (tmp_path / "_runs").iterdir()}
    assert left == {"first", "second", "writing"}

    publish_run(spark, root, "writing")
    assert current_root(spark, root) == run_root(root, "writing")
    assert {p.name for p in (tmp_path / "_runs").iterdir()} == {last, "writing"}
    assert remove_abandoned(spark, root, 0) == []


def test_a_number_without_content_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    publish_run(spark, root, "a")
    (tmp_path / "_published" / "000000002").touch()  # another job has taken the number and not written yet
    assert current_root(spark, root) == run_root(root, "a")
    publish_run(spark, root, "b")
    assert current_root(spark, root) == run_root(root, "b")


def test_abandoned_runs_go_by_age(spark, tmp_path):
    root = str(tmp_path)
    for run in ("dead", "live"):
        (tmp_path / "_runs" / run).mkdir(parents=True)
        (tmp_path / "_runs" / run / "part").write_text("x")
    for path in (tmp_path / "_runs" / "dead", tmp_path / "_runs" / "dead" / "part"):
        os.utime(path, (1, 1))
    assert remove_abandoned(spark, root, 24) == ["dead"]
    assert [p.name for p in (tmp_path / "_runs").iterdir()] == ["live"]


def test_cached_releases(spark):
    df = spark.range(10).withColumn("x", F.lit(1))
    with cached(df, ["id"]) as kept:
        assert kept.columns == ["id"] and kept.storageLevel.useMemory and kept.count() == 10
    assert not kept.storageLevel.useMemory
