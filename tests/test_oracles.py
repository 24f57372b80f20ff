"""Every registered query against an independent DuckDB query."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracles.compare import connect, differences
from oracles.sql import oracle_queries

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry._QUERIES, oracle_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def tables(spark):
    """Layers over one kept copy of silver, so that it is built once for all tests."""
    shared = entry.Tables(spark, SF_DIR)
    kept = shared.silver.persist()
    shared.silver = kept
    yield shared
    kept.unpersist()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(tables, con, key):
    assert differences(entry._QUERIES[key](tables), con, ORACLES[key]) == []


def test_sample_returns_the_requested_number_of_rows(tables):
    assert entry._QUERIES["s02_sample"](tables).first().n_rows == 1000


def test_fixture_sizes(tables):
    assert tables.raw.count() == 35_946
    assert tables.silver.count() == 35_237
    assert tables.silver.filter("Tot_Srvcs IS NULL").count() == 739
    assert tables.silver.filter("Avg_Mdcr_Stdzd_Amt IS NULL").count() == 709
    assert tables.silver.filter("Is_Participating IS NULL").count() == 1_076
    assert tables.silver.filter("RUCA_Int IS NULL").count() == 2_565
    assert tables.site.count() == 271 and tables.dim_hcpcs.count() == 299
