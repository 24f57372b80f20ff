"""DuckDB queries that compute each registered result a second way.

Money is integer cents here and derived ratios are integer millionths, divided
half up in integer arithmetic, so their rounding path differs from the Spark code.
"""

from __future__ import annotations

from feescope.schemas import RAW_COLUMNS

from .fixture import DUCKDB_RAW_SQL

# --- integer arithmetic ------------------------------------------------------


def _half_up(num: str, den: str) -> str:
    """num / den rounded half away from zero, both whole numbers, den > 0."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"(CASE WHEN {den} > 0 THEN sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) END)"


def _money(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"


def _ratio(millionths: str) -> str:
    return f"CAST(CAST({millionths} AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(12,6))"


def _ratio_of(num: str, den: str) -> str:
    return _ratio(_half_up(f"({num}) * 1000000", den))


def _double_ratio(num: str, den: str) -> str:
    """A ratio of two double columns: divided as doubles, rounded half up on the shortest text.

    The columns are doubles by contract, so 152.39 / 160 is 0.9524374999999999,
    which rounds down, and not the exact 0.9524375.
    """
    return f"(CASE WHEN {den} > 0 THEN CAST(CAST({num} / {den} AS VARCHAR) AS DECIMAL(12,6)) END)"


def _cents(amount: str) -> str:
    return f"CAST(round({amount} * 100) AS HUGEINT)"


def _avg_ratio(column: str) -> str:
    """Mean of a ratio column at ten decimals."""
    total = f"sum(CAST({column} * 1000000 AS HUGEINT)) * 10000"
    mean = _half_up(total, f"count({column})")
    return f"CAST(CAST({mean} AS DECIMAL(18,0)) * 0.0000000001 AS DECIMAL(16,10))"


def _sum_money(column: str) -> str:
    return f"CAST(sum({column}) AS DECIMAL(18,2))"


def _big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


# --- silver ------------------------------------------------------------------

_RAW = RAW_COLUMNS
_WHOLE = {"Tot_Benes": "INTEGER", "Tot_Srvcs": "BIGINT", "Tot_Bene_Day_Srvcs": "BIGINT"}
_TEXT = [n for n in _RAW if n not in _WHOLE and not n.startswith("Avg_")]

_TRIMMED = "SELECT " + ", ".join(f"nullif(trim({n}, ' '), '') AS {n}" for n in _RAW) + " FROM raw"

_TYPED = (
    "SELECT "
    + ", ".join(_TEXT)
    + ", "
    + ", ".join(f"TRY_CAST(trunc(TRY_CAST({n} AS DOUBLE)) AS {t}) AS {n}" for n, t in _WHOLE.items())
    + ", "
    + ", ".join(f"TRY_CAST({n} AS DOUBLE) AS {n}" for n in _RAW if n.startswith("Avg_"))
    + " FROM trimmed"
)

# Tokens: dots deleted, other characters to blanks, neighbouring single letters
# joined. A joined run is marked with "~" while it may still grow.
_TOKENS = """
SELECT *, string_split(replace(list_reduce(
    list_transform(
      string_split(trim(regexp_replace(replace(upper(coalesce(Rndrng_Prvdr_Crdntls, '')), '.', ''),
                                       '[^A-Z]+', ' ', 'g')), ' '),
      lambda x: CASE WHEN length(x) = 1 THEN x || '~' ELSE x END),
    lambda a, b: CASE WHEN a LIKE '%~' AND b LIKE '%~' THEN rtrim(a, '~') || b ELSE a || ' ' || b END
  ), '~', ''), ' ') AS tok
FROM typed WHERE Rndrng_Prvdr_Cntry = 'US'
"""


def _any_token(words: str) -> str:
    return " OR ".join(f"list_contains(tok, '{w}')" for w in words.split())


_TIER = f"""CASE
  WHEN {_any_token('MD DO MBBS')} THEN 'Physician (MD/DO)'
  WHEN {_any_token('NP ARNP APRN FNP CRNP CNP DNP FNPBC FNPC NPC')} THEN 'Nurse Practitioner'
  WHEN {_any_token('PA PAC RPAC')} THEN 'Physician Assistant'
  WHEN {_any_token('OD DPM DDS DMD DC PHD PSYD AUD PT DPT OT OTR CRNA CNM LCSW PHARMD SLP')}
    THEN 'Specialist'
  ELSE 'Other/Unknown' END"""

_S, _A = _cents("Avg_Sbmtd_Chrg"), _cents("Avg_Mdcr_Alowd_Amt")
_P, _Z = _cents("Avg_Mdcr_Pymt_Amt"), _cents("Avg_Mdcr_Stdzd_Amt")
_RUCA = "CAST(trunc(TRY_CAST(Rndrng_Prvdr_RUCA AS DOUBLE)) AS INTEGER)"

_SILVER = f"""
SELECT {', '.join(_RAW)},
  sha256(concat_ws('||', Rndrng_NPI, HCPCS_Cd, Place_Of_Srvc)) AS service_sk,
  {_money(f'{_S} * Tot_Srvcs')} AS Tot_Sbmtd_Chrg,
  {_money(f'{_A} * Tot_Srvcs')} AS Tot_Mdcr_Alowd_Amt,
  {_money(f'{_P} * Tot_Srvcs')} AS Tot_Mdcr_Pymt_Amt,
  {_money(f'{_Z} * Tot_Srvcs')} AS Tot_Mdcr_Stdzd_Amt,
  {_money(f'({_P} - {_Z}) * Tot_Srvcs')} AS Geo_Premium,
  {_money(f'({_S} - {_P}) * Tot_Benes')} AS Patient_Exposure,
  {_double_ratio('Avg_Sbmtd_Chrg', 'Avg_Mdcr_Alowd_Amt')} AS Markup_Ratio,
  {_double_ratio('Avg_Mdcr_Pymt_Amt', 'Avg_Mdcr_Alowd_Amt')} AS Mdcr_Pymt_Rate,
  {_double_ratio('Avg_Mdcr_Pymt_Amt', 'Avg_Mdcr_Stdzd_Amt')} AS Geo_Adj_Factor,
  HCPCS_Drug_Ind = 'Y' AS Is_Drug,
  Place_Of_Srvc = 'F' AS Is_Facility,
  Rndrng_Prvdr_Mdcr_Prtcptg_Ind = 'Y' AS Is_Participating,
  Rndrng_Prvdr_Ent_Cd = 'O' AS Is_Org,
  {_RUCA} AS RUCA_Int,
  {_RUCA} >= 4 AND {_RUCA} <= 10 AS Is_Rural,
  CASE WHEN {_RUCA} IN (1, 2, 3) THEN 'Urban' WHEN {_RUCA} IN (4, 5, 6) THEN 'Large rural'
       WHEN {_RUCA} IN (7, 8, 9, 10) THEN 'Small rural / isolated' ELSE 'Unknown' END AS RUCA_Bucket,
  {_TIER} AS Provider_Tier,
  CAST(2023 AS INTEGER) AS Source_Year
FROM tokens
"""

# --- fact and dimensions -----------------------------------------------------

_FACT_NAMES = {
    "npi": "Rndrng_NPI",
    "specialty": "Rndrng_Prvdr_Type",
    "state_abrvtn": "Rndrng_Prvdr_State_Abrvtn",
    "place_of_srvc": "Place_Of_Srvc",
}
_FACT_COLUMNS = (
    "service_sk npi specialty provider_tier state_abrvtn ruca_int ruca_bucket is_rural "
    "is_participating is_org hcpcs_cd is_drug place_of_srvc is_facility "
    "Tot_Benes Tot_Srvcs Tot_Bene_Day_Srvcs "
    "Avg_Sbmtd_Chrg Avg_Mdcr_Alowd_Amt Avg_Mdcr_Pymt_Amt Avg_Mdcr_Stdzd_Amt "
    "Tot_Sbmtd_Chrg Tot_Mdcr_Alowd_Amt Tot_Mdcr_Pymt_Amt Tot_Mdcr_Stdzd_Amt "
    "Markup_Ratio Mdcr_Pymt_Rate Geo_Adj_Factor Geo_Premium Patient_Exposure"
).split()
_FACT = (
    "SELECT "
    + ", ".join(f"{_FACT_NAMES.get(n, n)} AS {n}" for n in _FACT_COLUMNS)
    + " FROM silver"
)


def _pick(column: str, name: str) -> str:
    order = f"HCPCS_Cd NULLS FIRST, Place_Of_Srvc NULLS FIRST, {column}"
    return f"first({column} ORDER BY {order}) FILTER (WHERE {column} IS NOT NULL) AS {name}"


_PROVIDER_PICKS = [
    ("Rndrng_Prvdr_Last_Org_Name", "last_org_name"),
    ("Rndrng_Prvdr_First_Name", "first_name"),
    ("Rndrng_Prvdr_Crdntls", "credentials_raw"),
    ("Provider_Tier", "provider_tier"),
    ("Rndrng_Prvdr_Ent_Cd", "ent_cd"),
    ("Is_Org", "is_org"),
    ("Rndrng_Prvdr_Type", "specialty"),
    ("Rndrng_Prvdr_Mdcr_Prtcptg_Ind", "participation"),
    ("Is_Participating", "is_participating"),
    ("Rndrng_Prvdr_City", "city"),
    ("Rndrng_Prvdr_State_Abrvtn", "state_abrvtn"),
    ("Rndrng_Prvdr_State_FIPS", "state_fips"),
    ("Rndrng_Prvdr_Zip5", "zip5"),
    ("RUCA_Int", "ruca_int"),
    ("RUCA_Bucket", "ruca_bucket"),
    ("Is_Rural", "is_rural"),
]

_DIM_PROVIDER = f"""
SELECT *, CASE WHEN is_org THEN last_org_name
               WHEN first_name IS NULL THEN coalesce(last_org_name, '')
               WHEN last_org_name IS NULL THEN first_name
               ELSE first_name || ' ' || last_org_name END AS display_name
FROM (
  SELECT Rndrng_NPI AS npi, {', '.join(_pick(c, n) for c, n in _PROVIDER_PICKS)},
    {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_mdcr_pymt,
    {_big('sum(Tot_Srvcs)')} AS total_services,
    count(DISTINCT HCPCS_Cd) AS n_distinct_hcpcs
  FROM silver GROUP BY 1)
"""

_DIM_HCPCS = f"""
SELECT HCPCS_Cd AS hcpcs_cd, {_pick('HCPCS_Desc', 'hcpcs_desc')},
  {_pick('HCPCS_Drug_Ind', 'hcpcs_drug_ind')}, {_pick('Is_Drug', 'is_drug')},
  {_big('sum(Tot_Srvcs)')} AS national_services,
  {_sum_money('Tot_Mdcr_Pymt_Amt')} AS national_mdcr_pymt,
  count(DISTINCT Rndrng_NPI) AS n_providers,
  left(HCPCS_Cd, 1) AS hcpcs_family
FROM silver GROUP BY HCPCS_Cd
"""

_DIM_GEOGRAPHY = f"""
SELECT Rndrng_Prvdr_State_Abrvtn AS state_abrvtn,
  {_pick('Rndrng_Prvdr_State_FIPS', 'state_fips')},
  count(DISTINCT Rndrng_NPI) AS n_providers,
  {_big('sum(Tot_Benes)')} AS total_benes_proxy,
  {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_mdcr_pymt,
  CAST(count(*) FILTER (WHERE Is_Rural) AS DOUBLE) / count(*) AS rural_share_of_rows,
  {_avg_ratio('Geo_Adj_Factor')} AS avg_geo_adj_factor
FROM silver GROUP BY 1
"""

# --- marts -------------------------------------------------------------------

_BASKET = """
SELECT hcpcs_cd, CAST(sum(Tot_Srvcs) AS BIGINT) AS total_services
FROM fact GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 50
"""

_GEO = f"""
SELECT state_abrvtn, ruca_bucket,
  {_sum_money('Geo_Premium')} AS total_geo_premium,
  {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_pymt,
  {_sum_money('Tot_Mdcr_Stdzd_Amt')} AS total_stdzd,
  {_big('sum(Tot_Benes)')} AS total_benes_proxy,
  {_big('sum(Tot_Srvcs)')} AS total_services,
  {_avg_ratio('Geo_Adj_Factor')} AS avg_geo_adj_factor,
  {_money(_half_up('sum(Geo_Premium) * 100', 'sum(Tot_Benes)'))} AS geo_premium_per_bene
FROM fact
WHERE hcpcs_cd IN (SELECT hcpcs_cd FROM basket) AND Avg_Mdcr_Stdzd_Amt IS NOT NULL
GROUP BY 1, 2
"""


def _mean(amount: str, weight: str) -> str:
    """Weighted mean in whole cents."""
    return _half_up(f"sum({_cents(amount)} * {weight})", f"sum({weight})")


_EXPOSURE = f"""
SELECT specialty, is_participating,
  {_money('ms')} AS wavg_sbmtd_chrg, {_money('mp')} AS wavg_mdcr_pymt,
  {_money('ms - mp')} AS wavg_patient_exposure,
  total_benes, total_services, total_mdcr_pymt, n_providers
FROM (
  SELECT specialty, is_participating,
    {_mean('Avg_Sbmtd_Chrg', 'Tot_Benes')} AS ms, {_mean('Avg_Mdcr_Pymt_Amt', 'Tot_Benes')} AS mp,
    {_big('sum(Tot_Benes)')} AS total_benes, {_big('sum(Tot_Srvcs)')} AS total_services,
    {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_mdcr_pymt, count(DISTINCT npi) AS n_providers
  FROM fact GROUP BY 1, 2)
"""

_NON_PAR = f"""
SELECT sp.specialty,
  y.wavg_patient_exposure AS exposure_par_Y, y.n_providers AS n_providers_Y,
  y.total_mdcr_pymt AS total_mdcr_pymt_Y,
  n.wavg_patient_exposure AS exposure_par_N, n.n_providers AS n_providers_N,
  n.total_mdcr_pymt AS total_mdcr_pymt_N,
  {_ratio_of('(n.wavg_patient_exposure - y.wavg_patient_exposure) * 100',
             'y.wavg_patient_exposure * 100')} AS non_par_premium_pct
FROM (SELECT DISTINCT specialty FROM exposure) sp
LEFT JOIN exposure y ON y.specialty IS NOT DISTINCT FROM sp.specialty AND y.is_participating
LEFT JOIN exposure n ON n.specialty IS NOT DISTINCT FROM sp.specialty AND NOT n.is_participating
"""

_PROVIDER_DRUG = f"""
SELECT *, {_ratio_of('drug_mdcr_pymt * 100', 'total_mdcr_pymt * 100')} AS drug_share,
  {_ratio_of('drug_mdcr_pymt * 100', 'total_mdcr_pymt * 100')} > 0.60 AS is_drug_dependent
FROM (
  SELECT npi, specialty, state_abrvtn,
    {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_mdcr_pymt,
    {_sum_money('CASE WHEN is_drug THEN Tot_Mdcr_Pymt_Amt ELSE 0 END')} AS drug_mdcr_pymt,
    {_big('sum(CASE WHEN is_drug THEN Tot_Srvcs ELSE 0 END)')} AS drug_services,
    {_big('sum(Tot_Srvcs)')} AS total_services,
    count(DISTINCT CASE WHEN is_drug THEN hcpcs_cd END) AS n_distinct_jcodes
  FROM fact GROUP BY 1, 2, 3)
"""

_RUNNING = """
SELECT *, row_number() OVER (ORDER BY drug_mdcr_pymt, npi, specialty, state_abrvtn) AS rn,
  sum(drug_mdcr_pymt) OVER (ORDER BY drug_mdcr_pymt) AS cum_value,
  count(*) OVER () AS n_rows, sum(drug_mdcr_pymt) OVER () AS sum_value
FROM provider_drug WHERE drug_mdcr_pymt > 0
"""

_JCODE = f"""
SELECT npi, specialty, state_abrvtn, drug_mdcr_pymt, drug_services, total_mdcr_pymt,
  drug_share, is_drug_dependent,
  {_ratio_of('rn', 'n_rows')} AS cum_share_providers,
  {_ratio_of('cum_value * 100', 'sum_value * 100')} AS cum_share_drug
FROM running
"""

_TIER_MARKUP = f"""
SELECT provider_tier, hcpcs_cd, {_money('ms')} AS wavg_sbmtd_chrg, {_money('ma')} AS wavg_alowd,
  {_money('mp')} AS wavg_pymt, {_ratio_of('ms', 'ma')} AS wavg_markup_ratio,
  total_services, n_providers,
  hcpcs_cd IN ('99213', '99214', '99203', '99204', '99212', '99215') AS is_shared_e_and_m
FROM (
  SELECT provider_tier, hcpcs_cd, {_mean('Avg_Sbmtd_Chrg', 'Tot_Srvcs')} AS ms,
    {_mean('Avg_Mdcr_Alowd_Amt', 'Tot_Srvcs')} AS ma, {_mean('Avg_Mdcr_Pymt_Amt', 'Tot_Srvcs')} AS mp,
    {_big('sum(Tot_Srvcs)')} AS total_services, count(DISTINCT npi) AS n_providers
  FROM fact
  WHERE Markup_Ratio IS NOT NULL AND Tot_Srvcs >= 25 AND provider_tier <> 'Other/Unknown'
  GROUP BY 1, 2)
"""

_TIERS = {
    "Physician_MD_DO": "Physician (MD/DO)",
    "Nurse_Practitioner": "Nurse Practitioner",
    "Physician_Assistant": "Physician Assistant",
    "Specialist": "Specialist",
}


def _tier_columns() -> str:
    out = []
    for prefix, tier in _TIERS.items():
        only = f"FILTER (WHERE provider_tier = '{tier}')"
        out += [
            f"max(wavg_markup_ratio) {only} AS {prefix}_markup",
            f"max(wavg_pymt) {only} AS {prefix}_pymt",
            f"max(total_services) {only} AS {prefix}_svcs",
        ]
    return ", ".join(out)


_CREDENTIALS = f"""
SELECT w.*, d.hcpcs_desc FROM (
  SELECT hcpcs_cd, is_shared_e_and_m, {_tier_columns()} FROM tier_markup GROUP BY 1, 2) w
LEFT JOIN dim_hcpcs d USING (hcpcs_cd)
"""

_SITE_GRAIN = f"""
SELECT hcpcs_cd, place_of_srvc,
  {_money(_mean('Avg_Mdcr_Pymt_Amt', 'Tot_Srvcs'))} AS wavg_pymt,
  {_money(_mean('Avg_Mdcr_Stdzd_Amt', 'Tot_Srvcs'))} AS wavg_stdzd,
  {_big('sum(Tot_Srvcs)')} AS total_services,
  {_sum_money('Tot_Mdcr_Pymt_Amt')} AS total_pymt_amt
FROM fact WHERE place_of_srvc IN ('F', 'O') GROUP BY 1, 2
"""

_SITE = f"""
SELECT f.hcpcs_cd, f.wavg_pymt AS F_pymt, f.total_services AS F_svcs, f.total_pymt_amt AS F_total,
  o.wavg_pymt AS O_pymt, o.total_services AS O_svcs, o.total_pymt_amt AS O_total,
  {_ratio_of('f.wavg_pymt * 100', 'o.wavg_pymt * 100')} AS site_ratio,
  {_money('(f.wavg_pymt - o.wavg_pymt) * 100 * f.total_services')} AS site_neutral_savings,
  d.hcpcs_desc, d.is_drug
FROM site_grain f JOIN site_grain o ON f.hcpcs_cd = o.hcpcs_cd
LEFT JOIN dim_hcpcs d ON d.hcpcs_cd = f.hcpcs_cd
WHERE f.place_of_srvc = 'F' AND o.place_of_srvc = 'O'
  AND f.total_services >= 1000 AND o.total_services >= 1000
"""

_BY_STATE = f"""
SELECT state_abrvtn, {_sum_money('total_geo_premium')} AS total_geo_premium,
  {_big('sum(total_benes_proxy)')} AS total_benes_proxy,
  {_ratio(_half_up('sum(total_geo_premium) * 1000000', 'sum(total_benes_proxy)'))}
    AS geo_premium_per_bene
FROM geo GROUP BY 1
"""

_TOP_PAR = """
SELECT * FROM non_par WHERE non_par_premium_pct IS NOT NULL
ORDER BY non_par_premium_pct DESC, specialty LIMIT 12
"""

# Each relation may use the ones above it.
_RELATIONS = {
    "raw": DUCKDB_RAW_SQL,
    "trimmed": _TRIMMED,
    "typed": _TYPED,
    "tokens": _TOKENS,
    "silver": _SILVER,
    "fact": _FACT,
    "dim_provider": _DIM_PROVIDER,
    "dim_hcpcs": _DIM_HCPCS,
    "dim_geography": _DIM_GEOGRAPHY,
    "basket": _BASKET,
    "geo": _GEO,
    "exposure": _EXPOSURE,
    "non_par": _NON_PAR,
    "provider_drug": _PROVIDER_DRUG,
    "running": _RUNNING,
    "jcode": _JCODE,
    "tier_markup": _TIER_MARKUP,
    "credentials": _CREDENTIALS,
    "site_grain": _SITE_GRAIN,
    "site": _SITE,
    "by_state": _BY_STATE,
    "top_par": _TOP_PAR,
}


def query(body: str) -> str:
    """``body`` over the relations above, as one statement."""
    relations = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in _RELATIONS.items())
    return f"WITH {relations}\n{body}"


# --- one query per registered key --------------------------------------------

_KEY = "Rndrng_NPI, HCPCS_Cd, Place_Of_Srvc"
_EXPLORER = """p.npi, p.display_name, p.specialty, p.state_abrvtn, p.ruca_bucket,
  p.is_participating, p.provider_tier, p.total_mdcr_pymt, p.total_services,
  j.drug_share, j.is_drug_dependent"""


def _kpi(where: str = "TRUE") -> str:
    known = "count(is_participating)"
    absent = "count(*) FILTER (WHERE NOT is_participating)"
    return f"""
SELECT coalesce({_sum_money('total_mdcr_pymt')}, 0.00::DECIMAL(18,2)) AS total_mdcr_pymt,
  coalesce({_big('sum(total_services)')}, 0) AS total_services,
  count(DISTINCT npi) AS n_providers,
  CASE WHEN count(*) = 0 THEN 0.0::DECIMAL(12,6)
       ELSE {_ratio_of(f'100 * {absent}', known)} END AS non_par_pct,
  coalesce(CAST(trunc(median(n_distinct_hcpcs)) AS INTEGER), 0) AS median_codes
FROM dim_provider WHERE {where}"""


def _check(name: str, observed: str, passed: str, threshold: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, {passed} AS passed, "
        f"CAST({observed} AS DECIMAL(28,4)) AS observed, '{threshold}' AS threshold FROM {source}"
    )


def _none_where(name: str, condition: str) -> str:
    n = f"count(*) FILTER (WHERE {condition})"
    return _check(name, n, f"{n} = 0", "= 0", "silver")


def _unique(name: str, table: str, key: str) -> str:
    n = f"(count(*) - count(DISTINCT {key}) - CAST(count(*) > count({key}) AS INTEGER))"
    return _check(name, n, f"{n} = 0", "= 0", table)


def _band(name: str, table: str, low: int, high: int | None) -> str:
    if high is None:
        return _check(name, "count(*)", f"count(*) > {low}", f"> {low}", table)
    inside = f"count(*) BETWEEN {low + 1} AND {high - 1}"
    return _check(name, "count(*)", inside, f"> {low} and < {high}", table)


_DRIFT = f"abs(sum({_P} * Tot_Srvcs) - sum(Tot_Mdcr_Pymt_Amt) * 100)"

_CHECKS = {
    "d01_npi_not_null": _none_where("npi_not_null", "Rndrng_NPI IS NULL"),
    "d02_hcpcs_not_null": _none_where("hcpcs_not_null", "HCPCS_Cd IS NULL"),
    "d03_pos_in_domain": _none_where("pos_in_domain", "Place_Of_Srvc NOT IN ('F', 'O')"),
    "d04_ent_in_domain": _none_where("ent_in_domain", "Rndrng_Prvdr_Ent_Cd NOT IN ('I', 'O')"),
    "d05_benes_min_11": _none_where("benes_min_11", "Tot_Benes < 11"),
    "d06_ratios_nonneg": _none_where("ratios_nonneg", "Markup_Ratio < 0"),
    "d07_provider_tier_set": _none_where("provider_tier_set", "Provider_Tier IS NULL"),
    "d08_fact_row_count_band": _band("fact_row_count_band", "fact", 1000, None),
    "d09_dim_provider_unique": _unique("dim_provider_unique", "dim_provider", "npi"),
    "d10_dim_hcpcs_unique": _unique("dim_hcpcs_unique", "dim_hcpcs", "hcpcs_cd"),
    "d11_dim_geo_unique": _unique("dim_geo_unique", "dim_geography", "state_abrvtn"),
    "d12_dim_geo_reasonable": _band("dim_geo_reasonable", "dim_geography", 1, 65),
    "d13_decimal_drift": _check(
        "decimal_drift_zero", _DRIFT, f"{_DRIFT} < 1", "< 0.01", "silver"
    ),
}

_FK = " UNION ALL ".join(
    _check(f"fk_{dim}", "count(*)", "count(*) = 0", "= 0",
           f"fact WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {dim} WHERE {key} IS NOT NULL)")
    for dim, key in (("dim_provider", "npi"), ("dim_hcpcs", "hcpcs_cd"),
                     ("dim_geography", "state_abrvtn"))
)

_GOLD = {
    "dim_provider": "dim_provider",
    "dim_hcpcs": "dim_hcpcs",
    "dim_geography": "dim_geography",
    "fact_provider_service": "fact",
    "gold_hero_geo_arbitrage": "geo",
    "gold_hero_non_par_premium": "non_par",
    "gold_hero_jcode_concentration": "jcode",
    "gold_hero_credentials_markup": "credentials",
    "gold_hero_site_neutral": "site",
}

_SCATTER = """
SELECT hcpcs_cd, F_pymt, O_pymt, F_svcs, site_ratio, {rel} AS relative_volume,
  CAST((SELECT greatest(max(F_pymt), max(O_pymt)) FROM site
        WHERE F_pymt IS NOT NULL AND O_pymt IS NOT NULL) * 1.05 AS DECIMAL(22,4)) AS axis_max
FROM site WHERE F_pymt IS NOT NULL AND O_pymt IS NOT NULL
""".format(
    rel=_ratio_of(
        "F_svcs",
        "(SELECT max(F_svcs) FROM site WHERE F_pymt IS NOT NULL AND O_pymt IS NOT NULL)",
    )
)

# The area row by row: each trapezoid is 1/N wide.
_GINI = """
SELECT {value} AS gini, CAST(count(*) AS BIGINT) AS n_points
FROM (SELECT CAST(cum_share_drug * 1000000 AS HUGEINT) AS y,
        lag(CAST(cum_share_drug * 1000000 AS HUGEINT)) OVER (ORDER BY cum_share_providers) AS before
      FROM jcode)
"""


def _gini(first: str) -> str:
    """``first`` is what stands before the first point: NULL for parity, 0 for the origin."""
    twice = f"sum(CASE WHEN before IS NULL THEN coalesce({first} + y, 0) ELSE y + before END)"
    return _GINI.format(value=_ratio(_half_up(f"count(*) * 1000000 - {twice}", "count(*)")))


_LONG = " UNION ALL ".join(
    f"""SELECT hcpcs_cd, hcpcs_desc, '{tier}' AS provider_tier, {prefix}_markup AS markup_ratio,
  coalesce({prefix}_svcs, 0) AS services
FROM credentials WHERE is_shared_e_and_m AND {prefix}_markup IS NOT NULL"""
    for prefix, tier in _TIERS.items()
)

_PAR_POINTS = """
SELECT specialty, non_par_premium_pct, 'Participating (Y)' AS side, exposure_par_Y AS exposure FROM top_par
UNION ALL
SELECT specialty, non_par_premium_pct, 'Non-Par (N)', exposure_par_N FROM top_par
"""

_BODIES = {
    "s01_read_bronze": "SELECT * FROM trimmed",
    "s01_read_bronze_csv": "SELECT * FROM trimmed",
    "s01_read_bronze_lines": "SELECT * FROM trimmed",
    "s01_corrupt_count": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE Rndrng_NPI LIKE '%7') AS n_corrupt FROM trimmed",
    "s02_sample": "SELECT least(count(*), 1000) AS n_rows FROM trimmed",
    "s03_read_table": "SELECT * FROM silver",
    "s05_load_gold": "SELECT * FROM site",
    "s06_gold_status": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) = 0 AS is_empty FROM {relation}"
        for name, relation in _GOLD.items()
        if name not in ("dim_hcpcs", "dim_geography", "fact_provider_service")
    ),
    "k01_write_table": "SELECT * FROM dim_provider",
    "k02_partitioned_write": "SELECT * FROM fact",
    "k03_cluster_by": "SELECT * FROM fact",
    "k04_register_gold": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {relation}"
        for name, relation in _GOLD.items()
    ),
    "k05_cached_fact": "SELECT * FROM geo",
    "p01_trim_null": "SELECT * FROM trimmed",
    "p02_casts": f"SELECT {_KEY}, Rndrng_Prvdr_Cntry, {', '.join(_WHOLE)}, Avg_Sbmtd_Chrg, "
    "Avg_Mdcr_Alowd_Amt, Avg_Mdcr_Pymt_Amt, Avg_Mdcr_Stdzd_Amt FROM typed",
    "p03_keep_country": f"SELECT {_KEY}, Rndrng_Prvdr_Cntry FROM trimmed "
    "WHERE Rndrng_Prvdr_Cntry = 'US'",
    "p04_service_key": f"SELECT {_KEY}, service_sk FROM silver",
    "p05_money_totals": f"SELECT {_KEY}, Tot_Sbmtd_Chrg, Tot_Mdcr_Alowd_Amt, Tot_Mdcr_Pymt_Amt, "
    "Tot_Mdcr_Stdzd_Amt FROM silver",
    "p06_geo_premium": f"SELECT {_KEY}, Geo_Premium FROM silver",
    "p07_patient_exposure": f"SELECT {_KEY}, Patient_Exposure FROM silver",
    "p08_markup_ratio": f"SELECT {_KEY}, Markup_Ratio FROM silver",
    "p09_payment_rate": f"SELECT {_KEY}, Mdcr_Pymt_Rate FROM silver",
    "p10_geo_adj_factor": f"SELECT {_KEY}, Geo_Adj_Factor FROM silver",
    "p11_flags": f"SELECT {_KEY}, Is_Drug, Is_Facility, Is_Participating, Is_Org FROM silver",
    "p12_rural": f"SELECT {_KEY}, RUCA_Int, Is_Rural FROM silver",
    "p13_ruca_bucket": f"SELECT {_KEY}, RUCA_Bucket FROM silver",
    "p14_provider_tier": f"SELECT {_KEY}, Rndrng_Prvdr_Crdntls, Provider_Tier FROM silver",
    "p15_lineage": f"SELECT {_KEY}, Source_Year, '2024-01-01 00:00:00' AS Ingested_At FROM silver",
    "p16_silver": "SELECT * FROM silver",
    "p17_fact": "SELECT * FROM fact",
    "p18_display_name": "SELECT npi, is_org, first_name, last_org_name, display_name FROM dim_provider",
    "p19_hcpcs_family": "SELECT hcpcs_family, count(*) AS n_codes FROM dim_hcpcs GROUP BY 1",
    "p20_sanitize_columns": "SELECT hcpcs_cd, "
    + ", ".join(f"count(*) FILTER (WHERE provider_tier = '{t}') AS {p}" for p, t in _TIERS.items())
    + " FROM fact GROUP BY 1",
    "p21_shared_e_and_m": "SELECT hcpcs_cd, hcpcs_cd IN ('99213', '99214', '99203', '99204', "
    "'99212', '99215') AS is_shared_e_and_m FROM dim_hcpcs",
    "p22_renamed_aggregates": "SELECT state_abrvtn, n_providers FROM dim_geography",
    "p23_filters": "SELECT * FROM dim_provider WHERE state_abrvtn IN ('AX', 'BX', 'CX', 'DX', 'EX') "
    "AND ruca_bucket = 'Urban' AND specialty <> 'Specialty 0'",
    "p24_drop_null": f"SELECT {_KEY}, Geo_Premium FROM silver "
    "WHERE Geo_Premium IS NOT NULL AND Rndrng_Prvdr_RUCA IS NOT NULL",
    "a01_dim_provider": "SELECT * FROM dim_provider",
    "a02_dim_hcpcs": "SELECT * FROM dim_hcpcs",
    "a03_dim_geography": "SELECT * FROM dim_geography",
    "a04_top_codes": "SELECT * FROM basket",
    "a05_geo_arbitrage": "SELECT * FROM geo",
    "a06_participation_exposure": "SELECT * FROM exposure",
    "a07_non_par_premium": "SELECT * FROM non_par",
    "a08_provider_drug": "SELECT * FROM provider_drug",
    "a09_jcode_concentration": "SELECT * FROM jcode",
    "a10_lorenz_totals": "SELECT CAST(max(n_rows) AS BIGINT) AS n_rows, "
    "CAST(max(sum_value) AS DECIMAL(28,2)) AS sum_value FROM running",
    "a11_tier_markup": "SELECT * FROM tier_markup",
    "a12_credentials_markup": "SELECT * FROM credentials",
    "a13_site_grain": "SELECT * FROM site_grain",
    "a14_site_neutral": "SELECT * FROM site",
    "a15_kpi_ribbon": _kpi(),
    "a15_kpi_ribbon_filtered": _kpi("state_abrvtn IN ('AX', 'BX', 'CX', 'DX') "
                                    "AND ruca_bucket = 'Urban'"),
    "a16_geo_by_state": "SELECT * FROM by_state",
    "a17_gini": _gini("NULL"),
    "a17_gini_from_origin": _gini("0"),
    "a18_site_savings_total": "SELECT CAST(coalesce(sum(site_neutral_savings) FILTER "
    "(WHERE site_neutral_savings > 0), 0) AS DECIMAL(18,2)) AS total_savings FROM site",
    "a19_site_scatter": _SCATTER,
    "a20_state_options": "SELECT DISTINCT state_abrvtn FROM dim_provider "
    "WHERE state_abrvtn IS NOT NULL ORDER BY 1",
    "a20_specialty_options": "SELECT DISTINCT specialty FROM dim_provider "
    "WHERE specialty IS NOT NULL ORDER BY 1",
    "j01_markup_described": "SELECT hcpcs_cd, is_shared_e_and_m, hcpcs_desc FROM credentials",
    "j02_site_described": "SELECT hcpcs_cd, hcpcs_desc, is_drug FROM site",
    "j03_outlier_join": f"SELECT {_EXPLORER} FROM dim_provider p LEFT JOIN jcode j USING (npi)",
    "j04_basket_rows": "SELECT service_sk, hcpcs_cd FROM fact "
    "WHERE EXISTS (SELECT 1 FROM basket b WHERE b.hcpcs_cd = fact.hcpcs_cd)",
    "j05_scalar_attach": "SELECT npi, specialty, state_abrvtn, CAST(n_rows AS BIGINT) AS n_rows, "
    "CAST(sum_value AS DECIMAL(28,2)) AS sum_value FROM running",
    "w01_row_number": "SELECT npi, specialty, state_abrvtn, drug_mdcr_pymt, rn FROM running",
    "w02_running_sum": "SELECT npi, specialty, state_abrvtn, drug_mdcr_pymt, "
    "CAST(cum_value AS DECIMAL(28,2)) AS cum_value FROM running",
    "w03_cumulative_shares": "SELECT npi, specialty, state_abrvtn, cum_share_providers, "
    "cum_share_drug FROM jcode",
    "t01_top_codes": "SELECT * FROM basket",
    "t02_tornado": """
SELECT * FROM (SELECT * FROM by_state ORDER BY geo_premium_per_bene DESC NULLS LAST, state_abrvtn LIMIT 10)
UNION ALL
SELECT * FROM (SELECT * FROM by_state ORDER BY geo_premium_per_bene ASC NULLS LAST, state_abrvtn LIMIT 10)""",
    "t03_top_non_par": _PAR_POINTS,
    "t04_top_drug_codes": "SELECT hcpcs_cd, hcpcs_desc, national_mdcr_pymt FROM dim_hcpcs "
    "WHERE is_drug ORDER BY national_mdcr_pymt DESC NULLS LAST, hcpcs_cd LIMIT 25",
    "t05_outlier_explorer": f"SELECT {_EXPLORER} FROM dim_provider p LEFT JOIN jcode j USING (npi) "
    "ORDER BY p.total_mdcr_pymt DESC NULLS LAST, p.npi, j.drug_share DESC NULLS LAST, "
    "j.is_drug_dependent DESC NULLS LAST LIMIT 100",
    "t05_outlier_explorer_filtered": f"SELECT {_EXPLORER} FROM dim_provider p "
    "LEFT JOIN jcode j USING (npi) WHERE p.state_abrvtn IN ('AX', 'BX', 'CX', 'DX', 'EX', 'FX') "
    "AND p.ruca_bucket = 'Urban' ORDER BY p.total_mdcr_pymt DESC NULLS LAST, p.npi, "
    "j.drug_share DESC NULLS LAST, j.is_drug_dependent DESC NULLS LAST LIMIT 100",
    "t06_lorenz_curve": "SELECT cum_share_providers, cum_share_drug FROM jcode ORDER BY 1",
    "t07_unpivot_markup": _LONG,
    **_CHECKS,
    "d14_gate": "SELECT count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed, "
    "bool_and(passed) AS passed FROM ("
    + " UNION ALL ".join(f"({sql})" for sql in _CHECKS.values())
    + ")",
    "d15_idempotent_rerun": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, TRUE AS identical FROM {relation}"
        for name, relation in (("dim_hcpcs", "dim_hcpcs"), ("gold_hero_site_neutral", "site"))
    ),
    "d16_fk_integrity": _FK,
    "x06_duplicate_probes": _unique("service_sk_unique", "silver", "service_sk")
    + " UNION ALL "
    + _unique("jcode_npi_unique", "jcode", "npi"),
    "x03_dedup_service_key": "SELECT service_sk, Rndrng_NPI, HCPCS_Cd, Place_Of_Srvc FROM silver",
}


def oracle_queries() -> dict[str, str]:
    return {key: query(body) for key, body in _BODIES.items()}
