"""SQL (DuckDB dialect) building blocks of the oracle queries: the clean-up jobs and the merge
written as plain SQL over the shape views. These are the independent formulation the Spark code
is checked against, so they follow the reference's rules literally (e.g. the text-to-number rule
as the same sequence of replacements), not the Spark expressions."""

from __future__ import annotations

from .. import schema as S
from .oracle_shapes import SHAPE_SQL


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def numeric_text(x: str) -> str:
    """The usage-file rule: strip; drop % and ,; * -> nan; drop $; NA -> nan; nannan -> '';
    '' -> nan; to float (nan = missing)."""
    s = f"replace(replace(replace(replace(replace(trim({x}), '%', ''), ',', ''), '*', 'nan'), '$', ''), 'NA', 'nan')"
    s = f"replace({s}, 'nannan', '')"
    return f"(CASE WHEN {x} IS NULL OR {s} IN ('', 'nan') THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END)"


def canon(x: str) -> str:
    return f"regexp_replace({x}, '^0', '')"


def canon_float(x: str) -> str:
    """Key that went through a float: fraction cut off, all leading zeros gone (a lone 0 stays)."""
    return f"regexp_replace(split_part({x}, '.', 1), '^0+(.)', '\\1')"


def signed_coord(x: str) -> str:
    return f"(CASE WHEN substr({x}, 1, 1) = '+' THEN 1.0 ELSE -1.0 END * CAST(substr({x}, 2, length({x}) - 2) AS DOUBLE))"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    r = S.EARTH_RADIUS_KM * S.KM_TO_MILES
    h = (
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin((radians({lng2}) - radians({lng1})) / 2), 2)"
    )
    return f"({2 * r!r} * asin(sqrt(least(1.0, {h}))))"


def clean_survey() -> str:
    tok = in_list(S.SURVEY_MISSING_TOKENS)
    cols = ",\n  ".join(
        f"max(CASE WHEN code = '{c}' THEN TRY_CAST(CASE WHEN score IN ({tok}) THEN NULL ELSE score END AS DOUBLE) END) AS {c}"
        for c in S.SURVEY_CODES
    )
    return f"SELECT {canon('ccn')} AS ccn,\n  {cols}\nFROM survey_long GROUP BY ccn"


def clean_facility() -> str:
    return (
        f"SELECT {canon('ccn')} AS ccn, ownership, care_home, "
        "CAST(date_diff('day', CAST(strptime(cert_date, '%m/%d/%Y') AS DATE), DATE '2017-01-01') AS INTEGER) AS days_operation "
        "FROM facility"
    )


def clean_usage(with_empty: bool = True) -> str:
    ms = [m for m in S.USAGE_MEASURES if with_empty or m != "all_missing"]
    cols = ", ".join(f"{numeric_text(m)} AS {m}" for m in ms)
    key = canon_float("provider_id")
    return (
        f"SELECT {key} AS ccn, {cols} FROM usage_raw "
        f"WHERE summary_category = '{S.USAGE_SUMMARY_CATEGORY}' AND service_category = '{S.USAGE_SERVICE_CATEGORY}'"
    )


def city_coords() -> str:
    return (
        "SELECT lower(city || ' ' || state_id) AS k, arg_max(lat, ord) AS lat, arg_max(lng, ord) AS lng "
        "FROM city_lookup WHERE city IS NOT NULL AND state_id IS NOT NULL GROUP BY 1"
    )


def county_coords() -> str:
    return (
        f"SELECT county || ' ' || state AS k, arg_max({signed_coord('latitude')}, ord) AS lat, "
        f"arg_max({signed_coord('longitude')}, ord) AS lng "
        "FROM county_lookup WHERE county IS NOT NULL AND state IS NOT NULL GROUP BY 1"
    )


def provider_ctes() -> str:
    """CTEs p_kept, p_meas, p_ids, p_wide, p_cc, p_kc, p_geo, p_clean (the provider job)."""
    floats = S.PROVIDER_FLOATS
    tok = in_list(S.PROVIDER_MISSING_TOKENS)
    meas = ", ".join(f"max(CASE WHEN code = '{c}' THEN score END) AS {c}" for c in floats)
    ids = ", ".join(S.PROVIDER_ID_COLUMNS)
    textcols = [c for c in S.PROVIDER_ID_COLUMNS if c != "ccn"] + floats

    def tk(c):
        return f"(CASE WHEN {c} IN ({tok}) THEN NULL ELSE {c} END)"

    clean_cols = ", ".join(
        f"TRY_CAST({tk(c)} AS DOUBLE) AS {c}" if c in floats else f"{tk(c)} AS {c}" for c in textcols
    )
    return f"""p_kept AS (SELECT * FROM provider_long WHERE NOT contains(code, '{S.DROPPED_CODE_MARK}')),
p_meas AS (SELECT ccn, {meas} FROM p_kept GROUP BY ccn),
p_ids AS (SELECT DISTINCT {ids} FROM p_kept),
p_wide AS (SELECT p_ids.*, {', '.join('p_meas.' + c for c in floats)} FROM p_ids JOIN p_meas ON p_ids.ccn = p_meas.ccn
           WHERE state IS NULL OR state NOT IN ({in_list(S.EXCLUDED_STATES)})),
p_cc AS ({city_coords()}),
p_kc AS ({county_coords()}),
p_geo AS (SELECT p_wide.*,
             CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lat ELSE p_kc.lat END AS lat,
             CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lng ELSE p_kc.lng END AS lng
          FROM p_wide LEFT JOIN p_cc ON lower(p_wide.city || ' ' || p_wide.state) = p_cc.k
                      LEFT JOIN p_kc ON p_wide.county || ' ' || p_wide.state = p_kc.k),
p_clean AS (SELECT {canon('ccn')} AS ccn, {clean_cols}, lat, lng FROM p_geo)"""


PROVIDER_OUT = [c for c in S.PROVIDER_ID_COLUMNS if c != "ccn"] + S.PROVIDER_FLOATS + ["lat", "lng"]
USAGE_OUT = [m for m in S.USAGE_MEASURES if m != "all_missing"]
SHARE_OUT = list(S.DEMOGRAPHIC_COLUMNS)
FACILITY_OUT = ["ownership", "care_home", "days_operation"]
MERGED_COLUMNS = ["ccn"] + FACILITY_OUT + PROVIDER_OUT + USAGE_OUT + SHARE_OUT + list(S.SURVEY_CODES)


def merge_ctes() -> str:
    """CTEs up to m_joined (left-join chain) and merged (collapsed, state required)."""
    sel = ", ".join(
        ["f.*"]
        + [f"p.{c}" for c in PROVIDER_OUT]
        + [f"u.{c}" for c in USAGE_OUT]
        + [f"s.{c}" for c in SHARE_OUT]
        + [f"v.{c}" for c in S.SURVEY_CODES]
    )
    mins = ", ".join(f"min({q(c)}) AS {q(c)}" for c in MERGED_COLUMNS if c not in ("ccn", "lat", "lng"))
    return f"""{provider_ctes()},
m_fac AS ({clean_facility()}),
m_us AS ({clean_usage(with_empty=False)}),
m_sv AS ({clean_survey()}),
m_joined AS (SELECT {sel} FROM m_fac f LEFT JOIN p_clean p ON f.ccn = p.ccn LEFT JOIN m_us u ON f.ccn = u.ccn
             LEFT JOIN shares s ON f.ccn = s.ccn LEFT JOIN m_sv v ON f.ccn = v.ccn),
m_g AS (SELECT ccn, {mins}, min(lat) AS lat FROM m_joined GROUP BY ccn),
m_l AS (SELECT j.ccn, min(j.lng) AS lng FROM m_joined j JOIN m_g ON j.ccn = m_g.ccn AND j.lat = m_g.lat GROUP BY j.ccn),
merged AS (SELECT m_g.*, m_l.lng FROM m_g LEFT JOIN m_l ON m_g.ccn = m_l.ccn WHERE m_g.state IS NOT NULL)"""


MERGE_SHAPES = ("facility", "provider_ids", "provider_long", "city_lookup", "county_lookup", "usage_raw", "shares", "survey_long")


def with_shapes(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({SHAPE_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if names else body


def with_all(body_ctes: str, select: str, *names: str) -> str:
    """Shapes + extra CTEs + final select."""
    ctes = ",\n".join([f"{n} AS ({SHAPE_SQL[n]})" for n in names] + ([body_ctes] if body_ctes else []))
    return f"WITH {ctes}\n{select}"


GEO_OUT = ["n_win_30", "n_win_60", "n_win_90", "nearest"]


def radius_ctes(src: str, prefix: str = "g") -> str:
    """Brute-force radius counts and nearest distance over distinct places of ``src`` (lat, lng)."""
    d = haversine("a.lat", "a.lng", "b.lat", "b.lng")
    return f"""{prefix}_pl AS (SELECT lat, lng, count(*) AS w FROM {src} WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY lat, lng),
{prefix}_pd AS (SELECT a.lat, a.lng, b.w, {d} AS d FROM {prefix}_pl a JOIN {prefix}_pl b ON NOT (a.lat = b.lat AND a.lng = b.lng)),
{prefix}_pa AS (SELECT lat, lng, sum(CASE WHEN d < 30 THEN w ELSE 0 END) AS n30, sum(CASE WHEN d < 60 THEN w ELSE 0 END) AS n60,
                sum(CASE WHEN d < 90 THEN w ELSE 0 END) AS n90, min(d) AS mind FROM {prefix}_pd GROUP BY lat, lng),
{prefix}_gf AS (SELECT p.lat, p.lng, CAST(coalesce(a.n30, 0) + p.w - 1 AS BIGINT) AS n_win_30,
                CAST(coalesce(a.n60, 0) + p.w - 1 AS BIGINT) AS n_win_60, CAST(coalesce(a.n90, 0) + p.w - 1 AS BIGINT) AS n_win_90,
                CASE WHEN p.w > 1 THEN 0.0 ELSE a.mind END AS nearest
                FROM {prefix}_pl p LEFT JOIN {prefix}_pa a ON p.lat = a.lat AND p.lng = a.lng)"""
