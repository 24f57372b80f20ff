"""Data-quality checks: one aggregate per table, one report, one hard gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import weighted_sum

c = F.col

# Accepted row counts, both ends exclusive; None leaves an end open.
FACT_BAND = (100_000, 12_000_000)
FACT_BAND_SAMPLE = (1, 10_000)
#: The band for any number of release years.
FACT_BAND_OPEN = (100_000, None)
GEOGRAPHY_BAND = (40, 65)
GEOGRAPHY_BAND_SAMPLE = (1, 65)
DRIFT_TOLERANCE = 0.01

# Dimension keys, and the fact columns that refer to them.
KEYS = {"dim_provider": "npi", "dim_hcpcs": "hcpcs_cd", "dim_geography": "state_abrvtn"}

Band = tuple[int | None, int | None]

_OBSERVED = "decimal(28,4)"


class DataQualityError(AssertionError):
    """At least one check failed."""


def _line(name: str, observed: Column, passed: Column, threshold: str) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast(_OBSERVED).alias("observed"),
        F.lit(threshold).alias("threshold"),
    )


def _none_where(name: str, violation: Column) -> Column:
    bad = F.count_if(violation)
    return _line(name, bad, bad == 0, "= 0")


def _report(df: DataFrame, *lines: Column) -> DataFrame:
    """Evaluate all lines in one aggregation and return one row per line."""
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def silver_checks(silver: DataFrame, drift_tol: float = DRIFT_TOLERANCE) -> DataFrame:
    """Keys, domains, bounds and decimal drift of silver, in one scan.

    Codes outside a domain fail; a missing code passes. Drift compares stored
    cent totals with totals recomputed from averages, both added in decimal.
    """
    recomputed = weighted_sum(c("Avg_Mdcr_Pymt_Amt"), c("Tot_Srvcs"))
    zero = F.lit(0)
    drift = F.abs(F.coalesce(recomputed, zero) - F.coalesce(F.sum("Tot_Mdcr_Pymt_Amt"), zero))
    return _report(
        silver,
        _none_where("npi_not_null", c("Rndrng_NPI").isNull()),
        _none_where("hcpcs_not_null", c("HCPCS_Cd").isNull()),
        _none_where("pos_in_domain", ~c("Place_Of_Srvc").isin("F", "O")),
        _none_where("ent_in_domain", ~c("Rndrng_Prvdr_Ent_Cd").isin("I", "O")),
        _none_where("benes_min_11", c("Tot_Benes") < 11),
        _none_where("ratios_nonneg", c("Markup_Ratio") < 0),
        _none_where("provider_tier_set", c("Provider_Tier").isNull()),
        _line("decimal_drift_zero", drift, drift < drift_tol, f"< {drift_tol}"),
    )


def row_count_check(df: DataFrame, name: str, band: Band) -> DataFrame:
    """Row count strictly inside ``band``; an end that is None is open."""
    n = F.count(F.lit(1))
    return _report(df, _line(name, n, *_inside(n, band)))


def _inside(n: Column, band: Band) -> tuple[Column, str]:
    low, high = band
    ends = [(n > low, f"> {low}")] * (low is not None) + [(n < high, f"< {high}")] * (high is not None)
    passed = reduce(lambda a, b: a & b, [test for test, _ in ends], F.lit(True))
    return passed, " and ".join(text for _, text in ends) or "any"


def unique_check(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """No key twice; NULL counts as a value. ``observed`` is the number of surplus rows.

    Rows are counted per key first, which combines map-side, so a key with many
    copies is as cheap as any other.
    """
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    surplus = F.coalesce(F.sum(c("n") - 1), F.lit(0))
    return _report(copies, _line(name, surplus, surplus == 0, "= 0"))


def duplicate_probes(silver: DataFrame, jcode_mart: DataFrame) -> DataFrame:
    """Duplicates that are allowed but worth knowing; not part of the gate.

    Repeated service keys are kept by default, and a provider with two specialties
    or states has two points on the Lorenz curve and two rows in the explorer.
    """
    services = unique_check(silver, "service_sk_unique", "service_sk")
    return services.unionByName(unique_check(jcode_mart, "jcode_npi_unique", "npi"))


def run_checks(
    silver: DataFrame,
    fact: DataFrame | None,
    dims: Mapping[str, DataFrame],
    row_band: Band = FACT_BAND_OPEN,
    geo_band: Band = GEOGRAPHY_BAND,
    drift_tol: float = DRIFT_TOLERANCE,
) -> DataFrame:
    """All thirteen checks as ``(check_name, passed, observed, threshold)``.

    Without ``fact`` its row count is left to ``foreign_key_checks``, which counts rows on its way.
    """
    geography = dims["dim_geography"]
    parts = [
        silver_checks(silver, drift_tol),
        *([row_count_check(fact, "fact_row_count_band", row_band)] if fact is not None else []),
        unique_check(dims["dim_provider"], "dim_provider_unique", "npi"),
        unique_check(dims["dim_hcpcs"], "dim_hcpcs_unique", "hcpcs_cd"),
        unique_check(geography, "dim_geo_unique", "state_abrvtn"),
        row_count_check(geography, "dim_geo_reasonable", geo_band),
    ]
    return reduce(DataFrame.unionByName, parts)


def raw_checks(silver: DataFrame, raw: Mapping[str, int], exact: bool = True) -> DataFrame:
    """Corrupt raw records, and raw records that are in neither silver nor another country.

    ``raw`` holds ``n_raw``, ``n_corrupt`` and ``n_abroad`` as counted while silver was written.
    Without ``exact`` (rows were merged on purpose) silver may only have fewer rows.
    """
    expected = raw["n_raw"] - raw["n_corrupt"] - raw["n_abroad"]
    lost = F.lit(expected) - F.count(F.lit(1))
    corrupt = F.lit(raw["n_corrupt"])
    return _report(
        silver,
        _line("raw_corrupt_records", corrupt, corrupt == 0, "= 0"),
        _line("raw_records_kept", lost, lost == 0 if exact else lost >= 0, "= 0" if exact else ">= 0"),
    )


def foreign_key_checks(
    fact: DataFrame, dims: Mapping[str, DataFrame], row_band: Band | None = None
) -> DataFrame:
    """Fact rows whose key is in no dimension, one line per dimension; with ``row_band`` their number, too.

    One scan of the three key columns: each row gives a (dimension, key) pair per dimension, and pairs are counted before
    they meet the keys of all dimensions, so a hot key is not a hot join partition. It is an outer join
    with a test for no match, because Spark pushes an anti-join below the aggregation, back onto the raw
    rows. A missing key refers to nothing and passes.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("dim"), c(key).alias("key")) for name, key in KEYS.items()])
    used = fact.select(F.inline(pairs)).groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(
        DataFrame.unionByName,
        [dims[name].select(F.lit(name).alias("dim"), c(key).alias("key"), F.lit(True).alias("known")) for name, key in KEYS.items()],
    )
    met = used.join(known, ["dim", "key"], "left")
    lost = c("known").isNull() & c("key").isNotNull()

    def rows(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, c("n"))), F.lit(0))

    orphans = {name: rows(lost & (c("dim") == name)) for name in KEYS}
    lines = [_line(f"fk_{name}", n, n == 0, "= 0") for name, n in orphans.items()]
    if row_band is not None:
        n = rows(c("dim") == next(iter(KEYS)))
        lines.append(_line("fact_row_count_band", n, *_inside(n, row_band)))
    return _report(met, *lines)


def gate(report: DataFrame) -> DataFrame:
    """One row: number of checks, number failed, overall verdict."""
    failed = F.count_if(~c("passed"))
    return report.agg(
        F.count(F.lit(1)).alias("n_checks"),
        failed.alias("n_failed"),
        (failed == 0).alias("passed"),
    )


def assert_checks(report: DataFrame) -> list[tuple[str, bool]]:
    """Return every (name, passed) and raise if any failed; a report is a few rows."""
    results = [(r["check_name"], r["passed"]) for r in report.collect()]
    failed = [name for name, passed in results if not passed]
    if failed:
        raise DataQualityError(f"failed checks: {', '.join(failed)}")
    return results


def content_hash(df: DataFrame, exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-independent hash of all rows; equal content gives equal rows.

    With ``by`` one row per value of these columns. Both numbers are sums, so those of the parts add up to
    those of the whole.
    """
    cols = [n for n in df.columns if n not in set(exclude)]
    # A NULL leaves xxhash64's state unchanged, so its place is hashed as well.
    row = F.xxhash64(*cols, *[c(n).isNull() for n in cols])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(
            "content_hash"
        ),
    )


def changed_parts(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts in which two results of ``content_hash(..., by=by)`` differ, with the rows of both.

    A part that only one of them has counts as 0 rows in the other; NULL is a part like any other.
    """
    side, n, found = c("_second"), c("n_rows"), c("content_hash")
    both = first.withColumn("_second", F.lit(False)).unionByName(second.withColumn("_second", F.lit(True)))
    met = both.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~side, n)), F.lit(0)).alias("n_first"),
        F.coalesce(F.sum(F.when(side, n)), F.lit(0)).alias("n_second"),
        (F.min(found) == F.max(found)).alias("_equal"),
    )
    return met.filter(~c("_equal") | (c("n_first") != c("n_second"))).drop("_equal")
