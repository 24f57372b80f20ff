"""Raw-schema input derived from the given tables.

The one SQL text below defines the input for both engines: it is data, not an
operator, and runs unchanged in Spark SQL and DuckDB. Names, cities, descriptions and
specialties differ between the rows of one key, so that picks and grains are put to the test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

RAW_SQL = """
WITH g AS (
  SELECT l.l_suppkey AS k, l.l_linestatus AS pos,
    CASE WHEN p.p_type = 'PROMO' THEN concat('J', lpad(CAST(p.p_size AS varchar(10)), 4, '0'))
         WHEN p.p_type = 'STANDARD' AND p.p_size = 1 THEN '99213'
         WHEN p.p_type = 'STANDARD' AND p.p_size = 2 THEN '99214'
         WHEN p.p_type = 'STANDARD' AND p.p_size = 3 THEN '99203'
         WHEN p.p_type = 'STANDARD' AND p.p_size = 4 THEN '99204'
         WHEN p.p_type = 'STANDARD' AND p.p_size = 5 THEN '99212'
         WHEN p.p_type = 'STANDARD' AND p.p_size = 6 THEN '99215'
         ELSE concat(CASE p.p_type WHEN 'MEDIUM' THEN '6' WHEN 'STANDARD' THEN '7' WHEN 'LARGE' THEN '4'
                                   WHEN 'SMALL' THEN '3' ELSE '2' END,
                     lpad(CAST(p.p_size AS varchar(10)), 4, '0')) END AS hcpcs,
    CAST(sum(CAST(l.l_quantity AS bigint)) AS bigint) AS srvcs,
    CAST(count(*) AS bigint) AS n,
    CAST(sum(CAST(l.l_extendedprice AS decimal(18,2))) AS double) AS ext
  FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2, 3
), m AS (
  SELECT g.*, s.s_name, s.s_nationkey AS nk,
    CAST(floor(g.ext * 1e2 / CAST(g.srvcs AS double) + 1e-6) AS bigint) AS sb
  FROM g JOIN {supplier} s ON g.k = s.s_suppkey
), a AS (SELECT m.*, CAST(floor(sb * (40 + k % 30) / 1e2) AS bigint) AS al FROM m
), q AS (SELECT a.*, CAST(floor(al * 8 / 1e1) AS bigint) AS py FROM a
), t AS (SELECT q.*, CASE WHEN k % 37 = 5 THEN 0 ELSE CAST(floor(py * (90 + nk % 21) / 1e2) AS bigint) END AS sd FROM q)
SELECT CAST(1000000000 + k AS varchar(20)) AS Rndrng_NPI,
  concat('  ', s_name) AS Rndrng_Prvdr_Last_Org_Name,
  CASE WHEN k % 10 = 3 THEN '' ELSE concat('First', CAST((k + n) % 7 AS varchar(5))) END AS Rndrng_Prvdr_First_Name,
  CAST(NULL AS varchar(5)) AS Rndrng_Prvdr_MI,
  CASE k % 9 WHEN 0 THEN 'M.D.' WHEN 1 THEN 'D.O.' WHEN 2 THEN 'N.P.' WHEN 3 THEN ' PA-C ' WHEN 4 THEN 'O.D., F.A.A.O.'
    WHEN 5 THEN 'M.D., F.A.C.S.' WHEN 6 THEN 'MD' WHEN 7 THEN '   ' ELSE 'Esq.' END AS Rndrng_Prvdr_Crdntls,
  CASE WHEN k % 10 = 3 THEN 'O' ELSE 'I' END AS Rndrng_Prvdr_Ent_Cd,
  concat(CAST(k AS varchar(10)), ' MAIN ST') AS Rndrng_Prvdr_St1, '' AS Rndrng_Prvdr_St2,
  concat('City', CAST((k + n) % 7 AS varchar(5))) AS Rndrng_Prvdr_City,
  concat(chr(65 + nk), 'X') AS Rndrng_Prvdr_State_Abrvtn,
  lpad(CAST(nk + 1 AS varchar(5)), 2, '0') AS Rndrng_Prvdr_State_FIPS,
  lpad(CAST(10000 + k AS varchar(10)), 5, '0') AS Rndrng_Prvdr_Zip5,
  CASE WHEN k % 13 = 0 THEN '99' WHEN k % 13 = 12 THEN '' WHEN k % 13 = 11 THEN '4.1' ELSE CAST(k % 13 AS varchar(5)) END AS Rndrng_Prvdr_RUCA,
  'desc' AS Rndrng_Prvdr_RUCA_Desc,
  CASE WHEN nk = 24 THEN 'CA' ELSE 'US' END AS Rndrng_Prvdr_Cntry,
  concat('Specialty ', CAST((k + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) % 15 AS varchar(5))) AS Rndrng_Prvdr_Type,
  CASE WHEN k % 29 = 28 THEN '' WHEN floor(k / 15e0) % 5 = 0 THEN 'N' ELSE 'Y' END AS Rndrng_Prvdr_Mdcr_Prtcptg_Ind,
  hcpcs AS HCPCS_Cd, concat('Service ', hcpcs, CASE WHEN n % 3 = 0 THEN ' revised' ELSE '' END) AS HCPCS_Desc,
  CASE WHEN hcpcs LIKE 'J%' THEN 'Y' ELSE 'N' END AS HCPCS_Drug_Ind, pos AS Place_Of_Srvc,
  CAST(10 + n * 3 AS varchar(20)) AS Tot_Benes,
  CASE WHEN (k + n) % 41 = 0 THEN 'N/A' WHEN k % 2 = 0 THEN concat(CAST(srvcs AS varchar(20)), '.7') ELSE CAST(srvcs AS varchar(20)) END AS Tot_Srvcs,
  CAST(srvcs + n AS varchar(20)) AS Tot_Bene_Day_Srvcs,
  concat(CAST(CAST(floor(sb / 1e2) AS bigint) AS varchar(20)), '.', lpad(CAST(sb % 100 AS varchar(5)), 2, '0')) AS Avg_Sbmtd_Chrg,
  concat(CAST(CAST(floor(al / 1e2) AS bigint) AS varchar(20)), '.', lpad(CAST(al % 100 AS varchar(5)), 2, '0')) AS Avg_Mdcr_Alowd_Amt,
  concat(CAST(CAST(floor(py / 1e2) AS bigint) AS varchar(20)), '.', lpad(CAST(py % 100 AS varchar(5)), 2, '0')) AS Avg_Mdcr_Pymt_Amt,
  CASE WHEN k % 31 = 7 THEN ' ' ELSE concat(CAST(CAST(floor(sd / 1e2) AS bigint) AS varchar(20)), '.', lpad(CAST(sd % 100 AS varchar(5)), 2, '0')) END AS Avg_Mdcr_Stdzd_Amt
FROM t
"""

_TABLES = ("lineitem", "part", "supplier")

DUCKDB_RAW_SQL = RAW_SQL.format(**{name: name for name in _TABLES})


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 text columns, from lineitem, part and supplier."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES}
    return spark.sql(RAW_SQL, **tables)


#: Raw text is compressed, since the names of all columns are in every record, and cut into files of so many rows, since
#: a compressed file is read by one task.
RAW_FILE_ROWS = 500_000
RAW_FILES = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": RAW_FILE_ROWS}


def write_json_arrays(df: DataFrame, path: str, array_rows: int = RAW_FILE_ROWS) -> None:
    """Write one JSON array per file, the layout of the published raw files; a partition has one per ``array_rows`` records."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("value")
                at = np.arange(n, n + batch.num_rows) % array_rows
                lead = pa.array(np.where(at == 0, "[", ","), texts.type)
                trail = pa.array(np.where(at == array_rows - 1, "]", ""), texts.type)
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lead, texts, trail, "")], ["value"])
        if n % array_rows or not n:
            yield pa.RecordBatch.from_pydict({"value": ["]" if n else "[]"]})

    records = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    bracket = records.mapInArrow(bracketed, "value string")
    bracket.write.options(**RAW_FILES | {"maxRecordsPerFile": array_rows}).text(path)
