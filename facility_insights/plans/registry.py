"""Query registry: one Spark query per SURVEY §2 key, plus its DuckDB oracle where one exists.

Every query reads the driver's tables through the shape views and processes them whole. Double
outputs are rounded to 6 decimals on both sides so the value hashes compare numbers, not the
last bits of a floating-point sum.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .. import schema as S
from ..functions import canonical_key, parse_signed_coord
from ..operators import clean, features, merge, profile, reshape
from ..session import scratch_path
from ..sources import files
from ..sources import shapes as sh
from . import jobs
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(f):
        QUERIES[key] = f
        if oracle is not None:
            ORACLE[key] = oracle
        return f

    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every floating-point column to 6 decimals (for value-hash comparison); ``+ 0.0``
    turns a rounded -0.0 into 0.0 so the sign of a vanishing sum cannot change the hash."""
    return df.select(
        [(F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def flat_geo(df: DataFrame, col: str = "lat_long") -> DataFrame:
    return df.withColumn("lat", F.col(f"{col}.lat")).withColumn("lng", F.col(f"{col}.lng")).drop(col)


def R(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


# --------------------------------------------------------------------------------------------
# A. Sources and sinks
# --------------------------------------------------------------------------------------------

SURVEY_HEADERS = {"ccn": "CMS Certification Number (CCN)", "code": "Measure Code", "score": "Score"}


@register("scan_csv", Q.with_shapes("SELECT ccn, code, score FROM survey_long", "survey_long"))
def q_scan_csv(spark, sf_dir):
    path = scratch_path(spark, "survey_csv")
    src = sh.survey_long(spark, sf_dir).select([F.col(k).alias(v) for k, v in SURVEY_HEADERS.items()])
    files.export_csv(src, path)
    back = files.scan_csv(spark, path, columns=list(SURVEY_HEADERS.values()))
    return clean.rename_by_dictionary(back, {v: k for k, v in SURVEY_HEADERS.items()})


@register(
    "scan_sniffed",
    Q.with_shapes("SELECT CAST(ord AS VARCHAR) AS ord, county, state, latitude, longitude FROM county_lookup", "county_lookup"),
)
def q_scan_sniffed(spark, sf_dir):
    path = scratch_path(spark, "county_semicolon")
    files.export_csv(files.as_text_columns(sh.county_lookup(spark, sf_dir)), path, sep=";")
    return files.scan_sniffed(spark, path)


@register("roundtrip_parquet", Q.with_shapes(f"SELECT * FROM ({Q.clean_survey()})", "survey_long"))
def q_roundtrip_parquet(spark, sf_dir):
    path = scratch_path(spark, "survey_wide")
    files.write_parquet(jobs.clean_survey(sh.survey_long(spark, sf_dir)), path)
    return r6(files.read_parquet(spark, path))


@register(
    "export_csv",
    Q.with_shapes(
        f"SELECT ccn, ownership, care_home, CAST(days_operation AS VARCHAR) AS days_operation FROM ({Q.clean_facility()})",
        "facility",
    ),
)
def q_export_csv(spark, sf_dir):
    path = scratch_path(spark, "facility_csv")
    files.export_csv(jobs.clean_facility(sh.facility(spark, sf_dir)), path)
    return files.scan_csv(spark, path)


# --------------------------------------------------------------------------------------------
# B. Projection, filter, cast, scalar functions
# --------------------------------------------------------------------------------------------


@register("project", Q.with_shapes("SELECT ccn, code, score FROM provider_long", "provider_long"))
def q_project(spark, sf_dir):
    return sh.provider_long(spark, sf_dir).select("ccn", "code", "score")


@register("rename_by_dict", Q.with_shapes("SELECT provider_id, " + ", ".join(S.USAGE_MEASURES) + " FROM usage_raw", "usage_raw"))
def q_rename_by_dict(spark, sf_dir):
    long_names = {v: k for k, v in S.USAGE_DICTIONARY.items()}
    raw = sh.usage_raw(spark, sf_dir).select("provider_id", *[F.col(m).alias(long_names[m]) for m in S.USAGE_MEASURES])
    path = scratch_path(spark, "usage_csv")
    files.export_csv(raw, path)
    return clean.rename_by_dictionary(files.scan_csv(spark, path), S.USAGE_DICTIONARY)


@register("drop_columns", Q.with_shapes("SELECT ccn, name, city, state, county, code, score FROM provider_long", "provider_long"))
def q_drop_columns(spark, sf_dir):
    return sh.provider_long(spark, sf_dir).drop("address", "zip")


@register(
    "filter_not_contains",
    Q.with_shapes("SELECT ccn, code, score FROM provider_long WHERE NOT contains(code, 'DENOMINATOR')", "provider_long"),
)
def q_filter_not_contains(spark, sf_dir):
    return clean.filter_not_contains(sh.provider_long(spark, sf_dir), "code", S.DROPPED_CODE_MARK).select("ccn", "code", "score")


@register(
    "filter_not_in_keep_null",
    Q.with_shapes(f"SELECT * FROM provider_ids WHERE state IS NULL OR state NOT IN ({Q.in_list(S.EXCLUDED_STATES)})", "provider_ids"),
)
def q_filter_not_in_keep_null(spark, sf_dir):
    return clean.filter_not_in_keep_null(sh.provider_ids(spark, sf_dir), "state", S.EXCLUDED_STATES)


@register(
    "filter_and",
    Q.with_shapes(
        "SELECT provider_id, summary_category, service_category FROM usage_raw WHERE summary_category = 'PROVIDER' AND service_category = 'HOS'",
        "usage_raw",
    ),
)
def q_filter_and(spark, sf_dir):
    u = sh.usage_raw(spark, sf_dir)
    return u.where((F.col("summary_category") == "PROVIDER") & (F.col("service_category") == "HOS")).select(
        "provider_id", "summary_category", "service_category"
    )


@register(
    "filter_null",
    Q.with_shapes(
        "SELECT ccn, state, CASE WHEN y1 IS NULL THEN 'missing' ELSE 'present' END AS label_status FROM features_num "
        "WHERE y1 IS NULL OR x3 IS NOT NULL",
        "features_num",
    ),
)
def q_filter_null(spark, sf_dir):
    f = sh.features_num(spark, sf_dir)
    return f.where(F.col("y1").isNull() | F.col("x3").isNotNull()).select(
        "ccn", "state", F.when(F.col("y1").isNull(), "missing").otherwise("present").alias("label_status")
    )


@register(
    "lookup_entity",
    Q.with_shapes(
        "SELECT r.name, r.state, i.ccn FROM (SELECT DISTINCT name, state FROM provider_ids WHERE state IS NOT NULL) r "
        "JOIN provider_ids i ON i.name = r.name AND i.state = r.state",
        "provider_ids",
    ),
)
def q_lookup_entity(spark, sf_dir):
    """Every (name, state) selection resolved to all its keys at once (a key join, not a loop)."""
    ids = sh.provider_ids(spark, sf_dir)
    requests = ids.select("name", "state").where(F.col("state").isNotNull()).distinct()
    return lookup_entities(ids, requests)


def lookup_entities(ids: DataFrame, requests: DataFrame) -> DataFrame:
    """(name, state) requests -> all matching keys (several when the name repeats in a state)."""
    return requests.join(ids.select("name", "state", "ccn"), ["name", "state"])


@register(
    "sentinels_to_null",
    Q.with_shapes(
        f"SELECT ccn, code, CASE WHEN score IN ({Q.in_list(S.SURVEY_MISSING_TOKENS)}) THEN NULL ELSE score END AS score FROM survey_long",
        "survey_long",
    ),
)
def q_sentinels_to_null(spark, sf_dir):
    return clean.sentinels_to_null(sh.survey_long(spark, sf_dir), S.SURVEY_MISSING_TOKENS, ["score"])


@register(
    "clean_numeric_text",
    Q.with_shapes(
        "SELECT provider_id, " + ", ".join(f"{Q.numeric_text(m)} AS {m}" for m in S.USAGE_MEASURES) + " FROM usage_raw", "usage_raw"
    ),
)
def q_clean_numeric_text(spark, sf_dir):
    u = sh.usage_raw(spark, sf_dir).select("provider_id", *S.USAGE_MEASURES)
    return r6(clean.clean_numeric_columns(u, S.USAGE_MEASURES))


@register(
    "cast_columns",
    Q.with_shapes(
        f"SELECT ccn, code, TRY_CAST(CASE WHEN score IN ({Q.in_list(S.SURVEY_MISSING_TOKENS)}) THEN NULL ELSE score END AS DOUBLE) AS score "
        "FROM survey_long",
        "survey_long",
    ),
)
def q_cast_columns(spark, sf_dir):
    s = clean.sentinels_to_null(sh.survey_long(spark, sf_dir), S.SURVEY_MISSING_TOKENS, ["score"])
    return clean.cast_columns(s, ["score"], "double")


@register(
    "canonical_key",
    Q.with_shapes(
        f"SELECT ccn AS ccn_raw, {Q.canon('ccn')} AS ccn FROM facility UNION ALL "
        "SELECT provider_id || '.0', " + Q.canon_float("provider_id || '.0'") + " FROM usage_raw",
        "facility",
        "usage_raw",
    ),
)
def q_canonical_key(spark, sf_dir):
    """Keys of the facility table, and usage keys that went through a float ('100001.0')."""
    f = sh.facility(spark, sf_dir).select(F.col("ccn").alias("ccn_raw"), canonical_key("ccn").alias("ccn"))
    u = sh.usage_raw(spark, sf_dir).select(F.concat("provider_id", F.lit(".0")).alias("ccn_raw"))
    u = u.select("ccn_raw", canonical_key("ccn_raw", via_float=True).alias("ccn"))
    return f.unionByName(u)


@register("drop_all_null_columns", Q.with_shapes(f"SELECT * FROM ({Q.clean_usage(with_empty=False)})", "usage_raw"))
def q_drop_all_null_columns(spark, sf_dir):
    return r6(jobs.drop_empty_usage_columns(jobs.clean_usage(sh.usage_raw(spark, sf_dir))))


@register(
    "parse_signed_coord",
    Q.with_shapes(
        f"SELECT ord, {Q.signed_coord('latitude')} AS lat, {Q.signed_coord('longitude')} AS lng FROM county_lookup", "county_lookup"
    ),
)
def q_parse_signed_coord(spark, sf_dir):
    c = sh.county_lookup(spark, sf_dir)
    return r6(c.select("ord", parse_signed_coord("latitude").alias("lat"), parse_signed_coord("longitude").alias("lng")))


@register("days_since", Q.with_shapes(f"SELECT ccn, days_operation FROM ({Q.clean_facility()})", "facility"))
def q_days_since(spark, sf_dir):
    return jobs.clean_facility(sh.facility(spark, sf_dir)).select("ccn", "days_operation")


# --------------------------------------------------------------------------------------------
# C. Reshape
# --------------------------------------------------------------------------------------------


@register(
    "pivot_measures",
    Q.with_shapes(
        "SELECT ccn, " + ", ".join(f"max(CASE WHEN code = '{c}' THEN score END) AS {c}" for c in S.SURVEY_CODES)
        + " FROM survey_long GROUP BY ccn",
        "survey_long",
    ),
)
def q_pivot_measures(spark, sf_dir):
    return reshape.pivot_measures(sh.survey_long(spark, sf_dir), "ccn", "code", "score", levels=S.SURVEY_CODES, check_unique=True)


@register(
    "unpivot_measures",
    Q.with_shapes(
        "SELECT ccn, variable, value FROM (" + " UNION ALL ".join(
            f"SELECT ccn, '{c}' AS variable, {c} AS value FROM ({Q.clean_survey()})" for c in S.SURVEY_CODES
        ) + ")",
        "survey_long",
    ),
)
def q_unpivot_measures(spark, sf_dir):
    wide = jobs.clean_survey(sh.survey_long(spark, sf_dir))
    return reshape.unpivot_numeric(wide, ["ccn"], S.SURVEY_CODES)


def _one_hot_sql() -> str:
    return (
        "SELECT ccn, cert_date, "
        + ", ".join(
            f"CAST(coalesce(CAST(ownership = '{v}' AS INTEGER), 0) AS INTEGER) AS {Q.q('ownership_' + v)}"
            for v in ["Combination Government & Non-Profit", "For-Profit", "Government", "Non-Profit", "Other"]
        )
        + ", "
        + ", ".join(f"CAST(coalesce(CAST(care_home = '{v}' AS INTEGER), 0) AS INTEGER) AS {Q.q('care_home_' + v)}" for v in ["No", "Yes"])
        + " FROM facility"
    )


@register("one_hot", Q.with_shapes(_one_hot_sql(), "facility"))
def q_one_hot(spark, sf_dir):
    """Levels discovered from the data in one aggregate pass (the data-dependent schema step)."""
    return reshape.one_hot(sh.facility(spark, sf_dir), S.DUMMY_SOURCE_COLUMNS)


@register("missing_level", Q.with_shapes("SELECT ccn, coalesce(care_home, 'Missing') AS care_home FROM facility", "facility"))
def q_missing_level(spark, sf_dir):
    return reshape.missing_level(sh.facility(spark, sf_dir).select("ccn", "care_home"))


@register(
    "bind_columns",
    Q.with_shapes(
        f"SELECT f.ccn, f.ownership, f.days_operation, s.perc_white, s.perc_black FROM ({Q.clean_facility()}) f "
        "LEFT JOIN shares s ON f.ccn = s.ccn",
        "facility",
        "shares",
    ),
)
def q_bind_columns(spark, sf_dir):
    f = jobs.clean_facility(sh.facility(spark, sf_dir)).select("ccn", "ownership", "days_operation")
    s = sh.shares(spark, sf_dir).select("ccn", "perc_white", "perc_black")
    return r6(reshape.bind_columns(f, s, "ccn"))


# --------------------------------------------------------------------------------------------
# D. Joins (D1-D3, D7)
# --------------------------------------------------------------------------------------------


@register(
    "join_inner",
    Q.with_all(
        "k AS (SELECT * FROM provider_long WHERE NOT contains(code, 'DENOMINATOR')), "
        "m AS (SELECT ccn, " + ", ".join(f"max(CASE WHEN code = '{c}' THEN score END) AS {c}" for c in S.PROVIDER_FLOATS)
        + " FROM k GROUP BY ccn), i AS (SELECT DISTINCT " + ", ".join(S.PROVIDER_ID_COLUMNS) + " FROM k)",
        "SELECT i.*, " + ", ".join(f"m.{c}" for c in S.PROVIDER_FLOATS) + " FROM i JOIN m ON i.ccn = m.ccn",
        "provider_long",
    ),
)
def q_join_inner(spark, sf_dir):
    kept = clean.filter_not_contains(sh.provider_long(spark, sf_dir), "code", S.DROPPED_CODE_MARK)
    m = reshape.pivot_measures(kept.select("ccn", "code", "score"), levels=S.PROVIDER_FLOATS)
    return merge.join_identity_measures(kept.select(*S.PROVIDER_ID_COLUMNS), m)


@register(
    "merge_sources",
    Q.with_all(
        Q.merge_ctes(),
        "SELECT " + ", ".join(R(Q.q(c)) + " AS " + Q.q(c) if c in ("lat", "lng") else Q.q(c) for c in Q.MERGED_COLUMNS) + " FROM m_joined",
        *Q.MERGE_SHAPES,
    ),
)
def q_merge_sources(spark, sf_dir):
    usage = jobs.clean_usage(sh.usage_raw(spark, sf_dir)).drop("all_missing")
    joined = merge.merge_sources(
        jobs.clean_facility(sh.facility(spark, sf_dir)),
        jobs.clean_provider(sh.provider_long(spark, sf_dir), sh.city_lookup(spark, sf_dir), sh.county_lookup(spark, sf_dir)),
        usage,
        sh.shares(spark, sf_dir),
        jobs.clean_survey(sh.survey_long(spark, sf_dir)),
    )
    return r6(flat_geo(joined))


@register(
    "geo_lookup_cascade",
    Q.with_all(
        f"p_cc AS ({Q.city_coords()}), p_kc AS ({Q.county_coords()}), ids AS (SELECT DISTINCT * FROM provider_ids)",
        "SELECT ids.*, " + R("CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lat ELSE p_kc.lat END") + " AS lat, "
        + R("CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lng ELSE p_kc.lng END") + " AS lng "
        "FROM ids LEFT JOIN p_cc ON lower(ids.city || ' ' || ids.state) = p_cc.k "
        "LEFT JOIN p_kc ON ids.county || ' ' || ids.state = p_kc.k",
        "provider_ids",
        "city_lookup",
        "county_lookup",
    ),
)
def q_geo_lookup_cascade(spark, sf_dir):
    ids = sh.provider_ids(spark, sf_dir).dropDuplicates()
    out = merge.geo_lookup_cascade(ids, sh.city_lookup(spark, sf_dir), sh.county_lookup(spark, sf_dir))
    return r6(flat_geo(out))


_RESOLVE_SQL = Q.with_shapes(
    "SELECT f.ccn, CASE WHEN p.ccn IS NOT NULL THEN p.would_recommend ELSE f.y1 END AS y1, "
    "CASE WHEN p.ccn IS NOT NULL THEN p.rating_est ELSE f.y2 END AS y2, CAST(p.ccn IS NOT NULL AS INTEGER) AS is_predicted "
    "FROM features_num f LEFT JOIN predictions p ON f.ccn = p.ccn",
    "features_num",
    "predictions",
)


@register("resolve_scores", _RESOLVE_SQL)
def q_resolve_scores(spark, sf_dir):
    pred = sh.predictions(spark, sf_dir).select("ccn", F.col("would_recommend").alias("y1"), F.col("rating_est").alias("y2"))
    return r6(merge.resolve_scores(sh.features_num(spark, sf_dir), pred, ["y1", "y2"]))


@register(
    "semi_entities",
    Q.with_shapes("SELECT ccn, state FROM features_num f WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.ccn = f.ccn)", "features_num", "predictions"),
)
def q_semi_entities(spark, sf_dir):
    return sh.features_num(spark, sf_dir).select("ccn", "state").join(sh.predictions(spark, sf_dir), "ccn", "left_semi")


@register(
    "anti_entities",
    Q.with_shapes("SELECT ccn, state FROM features_num f WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.ccn = f.ccn)", "features_num", "predictions"),
)
def q_anti_entities(spark, sf_dir):
    return sh.features_num(spark, sf_dir).select("ccn", "state").join(sh.predictions(spark, sf_dir), "ccn", "left_anti")


# --------------------------------------------------------------------------------------------
# E. Distinct, duplicates, profiling
# --------------------------------------------------------------------------------------------


@register("distinct_rows", Q.with_shapes("SELECT DISTINCT * FROM provider_ids", "provider_ids"))
def q_distinct_rows(spark, sf_dir):
    return sh.provider_ids(spark, sf_dir).dropDuplicates()


@register(
    "duplicated_keys",
    Q.with_shapes(
        f"SELECT {Q.canon('ccn')} AS ccn, name, state, city, county FROM provider_ids WHERE {Q.canon('ccn')} IN "
        f"(SELECT {Q.canon('ccn')} FROM provider_ids GROUP BY 1 HAVING count(*) > 1)",
        "provider_ids",
    ),
)
def q_duplicated_keys(spark, sf_dir):
    ids = sh.provider_ids(spark, sf_dir).withColumn("ccn", canonical_key("ccn"))
    return merge.duplicated_keys(ids, "ccn", repeated=True)


_IDS_GEO = (
    f"p_cc AS ({Q.city_coords()}), p_kc AS ({Q.county_coords()}), "
    "x AS (SELECT " + Q.canon("i.ccn") + " AS ccn, i.name, i.state, i.city, i.county, "
    "CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lat ELSE p_kc.lat END AS lat, "
    "CASE WHEN p_cc.k IS NOT NULL THEN p_cc.lng ELSE p_kc.lng END AS lng "
    "FROM provider_ids i LEFT JOIN p_cc ON lower(i.city || ' ' || i.state) = p_cc.k "
    "LEFT JOIN p_kc ON i.county || ' ' || i.state = p_kc.k), "
    "g AS (SELECT ccn, min(name) AS name, min(state) AS state, min(city) AS city, min(county) AS county, min(lat) AS lat "
    "FROM x GROUP BY ccn), "
    "l AS (SELECT x.ccn, min(x.lng) AS lng FROM x JOIN g ON x.ccn = g.ccn AND x.lat = g.lat GROUP BY x.ccn)"
)
_COLLAPSE_SQL = Q.with_all(
    _IDS_GEO,
    f"SELECT g.ccn, g.name, g.state, g.city, g.county, {R('g.lat')} AS lat, {R('l.lng')} AS lng FROM g LEFT JOIN l ON g.ccn = l.ccn",
    "provider_ids",
    "city_lookup",
    "county_lookup",
)


def _ids_with_geo(spark, sf_dir) -> DataFrame:
    ids = sh.provider_ids(spark, sf_dir).withColumn("ccn", canonical_key("ccn"))
    return merge.geo_lookup_cascade(ids, sh.city_lookup(spark, sf_dir), sh.county_lookup(spark, sf_dir))


@register("collapse_duplicates", _COLLAPSE_SQL)
def q_collapse_duplicates(spark, sf_dir):
    return r6(flat_geo(merge.collapse_duplicates(_ids_with_geo(spark, sf_dir), "ccn")))


@register("union_rows", _COLLAPSE_SQL)
def q_union_rows(spark, sf_dir):
    """Untouched singletons ∪ collapsed duplicate groups (the reference's split-collapse-concat)."""
    x = _ids_with_geo(spark, sf_dir)
    singles = merge.duplicated_keys(x, "ccn", repeated=False)
    collapsed = merge.collapse_duplicates(merge.duplicated_keys(x, "ccn", repeated=True), "ccn")
    return r6(flat_geo(singles.unionByName(collapsed)))


def _survey_profile_sql() -> str:
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {R(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_frac FROM w" for c in S.SURVEY_CODES
    )
    return Q.with_all(f"w AS ({Q.clean_survey()})", body, "survey_long")


@register("missing_profile", _survey_profile_sql())
def q_missing_profile(spark, sf_dir):
    wide = jobs.clean_survey(sh.survey_long(spark, sf_dir))
    return r6(profile.missing_profile(wide, S.SURVEY_CODES))


def _missing_matrix_sql() -> str:
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{t}' AS target, "
        + R(f"avg(CASE WHEN {t} IS NOT NULL THEN (CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) END)")
        + " AS missing_frac FROM w"
        for t in S.SENTIMENT_COLUMNS
        for c in S.SURVEY_CODES
    )
    return Q.with_all(f"w AS ({Q.clean_survey()})", body, "survey_long")


@register("missing_matrix", _missing_matrix_sql())
def q_missing_matrix(spark, sf_dir):
    wide = jobs.clean_survey(sh.survey_long(spark, sf_dir))
    return r6(profile.missing_matrix(wide, S.SURVEY_CODES, S.SENTIMENT_COLUMNS))


# Merged-table helpers ------------------------------------------------------------------------


def merged(spark, sf_dir) -> DataFrame:
    return jobs.merged_from_shapes(spark, sf_dir)


def _merged_sql(select: str, extra_ctes: str = "") -> str:
    ctes = Q.merge_ctes() + ((",\n" + extra_ctes) if extra_ctes else "")
    return Q.with_all(ctes, select, *Q.MERGE_SHAPES)


MERGED_SELECT = ", ".join(R(Q.q(c)) + " AS " + Q.q(c) if c in ("lat", "lng") else Q.q(c) for c in Q.MERGED_COLUMNS)


@register("merge_all", _merged_sql(f"SELECT {MERGED_SELECT} FROM merged"))
def q_merge_all(spark, sf_dir):
    return r6(flat_geo(merged(spark, sf_dir)))


_WR = "(RECOMMEND_MBV + RECOMMEND_TBV)"
_RE = "(RATING_BBV * 0.01 * 3.5 + RATING_MBV * 0.01 * 7.5 + RATING_TBV * 0.01 * 9.5)"


@register(
    "benchmark_means",
    _merged_sql(
        "SELECT CASE WHEN GROUPING(state) = 1 THEN 'national' ELSE 'state' END AS scope, state, "
        f"{R(f'avg({_WR})')} AS would_recommend, {R(f'avg({_RE})')} AS RATING_EST, {R('avg(days_operation)')} AS days_operation "
        "FROM merged GROUP BY ROLLUP (state)"
    ),
)
def q_benchmark_means(spark, sf_dir):
    m = features.rating_estimate(features.would_recommend(merged(spark, sf_dir)))
    return r6(profile.benchmark_means(m, ["would_recommend", "RATING_EST", "days_operation"], by="state"))


@register("state_list", _merged_sql("SELECT DISTINCT state FROM merged WHERE state IS NOT NULL"))
def q_state_list(spark, sf_dir):
    return profile.sorted_distinct(merged(spark, sf_dir), "state")


@register("facility_list", _merged_sql("SELECT state, name FROM merged WHERE state IS NOT NULL"))
def q_facility_list(spark, sf_dir):
    return profile.entities_in_group(merged(spark, sf_dir), "state", "name")


@register(
    "state_coverage",
    _merged_sql(
        f"SELECT state, CAST(count(*) FILTER (WHERE {_WR} IS NOT NULL) AS BIGINT) AS n_values, "
        f"CAST(count(*) FILTER (WHERE {_WR} IS NOT NULL) > 0 AS INTEGER) AS enough FROM merged GROUP BY state"
    ),
)
def q_state_coverage(spark, sf_dir):
    m = features.would_recommend(merged(spark, sf_dir))
    return profile.group_coverage(m, "state", "would_recommend")


# --------------------------------------------------------------------------------------------
# I. Feature engineering
# --------------------------------------------------------------------------------------------


@register(
    "per_beneficiary",
    Q.with_all(
        f"u AS ({Q.clean_usage(with_empty=False)})",
        "SELECT ccn, "
        + R("total_charge / nullif(distinct_bens, 0)") + " AS total_charge_pb, "
        + R("nurse_visit_ct / nullif(distinct_bens, 0)") + " AS nurse_visit_ct_pb, "
        + R("(total_charge - nurse_visit_ct) / nullif(distinct_bens, 0)") + " AS charge_less_visits_pb FROM u",
        "usage_raw",
    ),
)
def q_per_beneficiary(spark, sf_dir):
    u = jobs.clean_usage(sh.usage_raw(spark, sf_dir))
    return r6(features.per_beneficiary(u).select("ccn", "total_charge_pb", "nurse_visit_ct_pb", "charge_less_visits_pb"))


def _demo_sql() -> str:
    tot = " + ".join(f"coalesce({c}, 0)" for c in S.DEMOGRAPHIC_COLUMNS)
    cols = ", ".join(f"CASE WHEN {tot} > 95 THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in S.DEMOGRAPHIC_COLUMNS)
    return Q.with_shapes(f"SELECT ccn, {cols}, 100 - perc_white AS perc_nonwhite FROM shares", "shares")


@register("impute_demographics", _demo_sql())
def q_impute_demographics(spark, sf_dir):
    return r6(features.impute_demographics(sh.shares(spark, sf_dir)))


def _survey_feature_sql(select: str) -> str:
    return Q.with_all(f"w AS ({Q.clean_survey()})", select, "survey_long")


_STEMS = S.SURVEY_STEMS


def _ratio_sql() -> str:
    btr = ", ".join(f"{s}_BBV / nullif({s}_TBV, 0) AS {s}_BTR" for s in _STEMS)
    stats = ", ".join(f"min({s}_BTR) AS mn_{s}, max({s}_BTR) AS mx_{s}" for s in _STEMS)
    out = ", ".join(
        R(f"1 - ({s}_BTR - mn_{s}) / (CASE WHEN mx_{s} - mn_{s} = 0 THEN 1 ELSE mx_{s} - mn_{s} END)") + f" AS {s}_BTR" for s in _STEMS
    )
    return Q.with_all(
        f"w AS ({Q.clean_survey()}), b AS (SELECT ccn, {btr} FROM w), st AS (SELECT {stats} FROM b)",
        f"SELECT ccn, {out} FROM b CROSS JOIN st",
        "survey_long",
    )


@register("quality_ratios", _ratio_sql())
def q_quality_ratios(spark, sf_dir):
    wide = jobs.clean_survey(sh.survey_long(spark, sf_dir))
    return r6(features.quality_ratios(wide).select("ccn", *[f"{s}_BTR" for s in _STEMS]))


@register("rating_estimate", _survey_feature_sql(f"SELECT ccn, {R(_RE)} AS RATING_EST FROM w"))
def q_rating_estimate(spark, sf_dir):
    return r6(features.rating_estimate(jobs.clean_survey(sh.survey_long(spark, sf_dir))).select("ccn", "RATING_EST"))


@register(
    "quality_adjusted",
    _survey_feature_sql("SELECT ccn, " + ", ".join(R(f"{s}_TBV / (1 + 0.01 * {s}_BBV)") + f" AS {s}_ADJ" for s in _STEMS) + " FROM w"),
)
def q_quality_adjusted(spark, sf_dir):
    w = features.quality_adjusted(jobs.clean_survey(sh.survey_long(spark, sf_dir)))
    return r6(w.select("ccn", *[f"{s}_ADJ" for s in _STEMS]))


@register(
    "managed_scores",
    _survey_feature_sql(
        "SELECT ccn, EMO_REL_TBV AS MANAGED_EMO_REL, "
        + ", ".join(f"{s}_TBV + {s}_MBV AS MANAGED_{s}" for s in S.MANAGED_STEMS)
        + " FROM w"
    ),
)
def q_managed_scores(spark, sf_dir):
    w = features.managed_scores(jobs.clean_survey(sh.survey_long(spark, sf_dir)))
    return r6(w.select("ccn", "MANAGED_EMO_REL", *[f"MANAGED_{s}" for s in S.MANAGED_STEMS]))


@register("would_recommend", _survey_feature_sql(f"SELECT ccn, {_WR} AS would_recommend FROM w"))
def q_would_recommend(spark, sf_dir):
    return r6(features.would_recommend(jobs.clean_survey(sh.survey_long(spark, sf_dir))).select("ccn", "would_recommend"))


@register(
    "for_profit_flag",
    Q.with_shapes("SELECT ccn, ownership, CAST(coalesce(CAST(ownership = 'For-Profit' AS INTEGER), 0) AS INTEGER) AS for_profit FROM facility", "facility"),
)
def q_for_profit_flag(spark, sf_dir):
    return features.for_profit_flag(sh.facility(spark, sf_dir).select("ccn", "ownership"))


# --------------------------------------------------------------------------------------------
# P. Clean-up jobs
# --------------------------------------------------------------------------------------------


@register("clean_survey", Q.with_shapes(f"SELECT * FROM ({Q.clean_survey()})", "survey_long"))
def q_clean_survey(spark, sf_dir):
    return r6(jobs.clean_survey(sh.survey_long(spark, sf_dir)))


@register(
    "clean_provider",
    Q.with_all(
        Q.provider_ctes(),
        "SELECT ccn, " + ", ".join(R(c) + f" AS {c}" if c in ("lat", "lng") else c for c in Q.PROVIDER_OUT) + " FROM p_clean",
        "provider_long",
        "city_lookup",
        "county_lookup",
    ),
)
def q_clean_provider(spark, sf_dir):
    p = jobs.clean_provider(sh.provider_long(spark, sf_dir), sh.city_lookup(spark, sf_dir), sh.county_lookup(spark, sf_dir))
    return r6(flat_geo(p))


@register("clean_facility", Q.with_shapes(f"SELECT * FROM ({Q.clean_facility()})", "facility"))
def q_clean_facility(spark, sf_dir):
    return jobs.clean_facility(sh.facility(spark, sf_dir))


@register("clean_usage", Q.with_shapes(f"SELECT * FROM ({Q.clean_usage(with_empty=False)})", "usage_raw"))
def q_clean_usage(spark, sf_dir):
    return r6(jobs.drop_empty_usage_columns(jobs.clean_usage(sh.usage_raw(spark, sf_dir))))


# --------------------------------------------------------------------------------------------
# D4. Radius self-join and nearest distance
# --------------------------------------------------------------------------------------------

_GEO_SQL = Q.with_all(
    Q.radius_ctes("geo_points"),
    "SELECT p.ccn, g.n_win_30, g.n_win_60, g.n_win_90, {nearest} FROM geo_points p JOIN g_gf g ON p.lat = g.lat AND p.lng = g.lng",
    "geo_points",
)


@register("radius_counts", _GEO_SQL.replace("{nearest}", "CAST(g.n_win_30 <= g.n_win_60 AND g.n_win_60 <= g.n_win_90 AS INTEGER) AS monotone"))
def q_radius_counts(spark, sf_dir):
    from ..operators import geo

    pts = sh.geo_points(spark, sf_dir)
    places = geo.place_weights(pts)
    feats = geo.place_features(places, nearest=False).drop("w")
    out = pts.join(feats, ["lat", "lng"])
    mono = ((F.col("n_win_30") <= F.col("n_win_60")) & (F.col("n_win_60") <= F.col("n_win_90"))).cast("int")
    return out.select("ccn", "n_win_30", "n_win_60", "n_win_90", mono.alias("monotone"))


@register("nearest_distance", _GEO_SQL.replace("g.n_win_30, g.n_win_60, g.n_win_90, {nearest}", "(round(g.nearest, 6) + 0.0) AS nearest"))
def q_nearest_distance(spark, sf_dir):
    from ..operators import geo

    pts = sh.geo_points(spark, sf_dir)
    feats = geo.place_features(geo.place_weights(pts)).select("lat", "lng", "nearest")
    return r6(pts.join(feats, ["lat", "lng"]).select("ccn", "nearest"))


# --------------------------------------------------------------------------------------------
# P6. Full feature table, E6 variable summary
# --------------------------------------------------------------------------------------------

OWNERSHIP_LEVELS = ["Combination Government & Non-Profit", "For-Profit", "Government", "Non-Profit", "Other"]
CARE_LEVELS = ["Missing", "No", "Yes"]


def _features_sql() -> str:
    stems = S.SURVEY_STEMS
    tot = " + ".join(f"coalesce({c}, 0)" for c in S.DEMOGRAPHIC_COLUMNS)
    demo = ", ".join(f"CASE WHEN {tot} > 95 THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in S.DEMOGRAPHIC_COLUMNS)
    keep = [c for c in Q.MERGED_COLUMNS if c not in S.DEMOGRAPHIC_COLUMNS and c not in ("ownership", "care_home")]
    f1 = (
        "f1 AS (SELECT " + ", ".join(f"m.{Q.q(c)}" for c in keep) + ", m.ownership, coalesce(m.care_home, 'Missing') AS care_home, "
        + demo + ", 100 - m.perc_white AS perc_nonwhite, g.n_win_30, g.n_win_60, g.n_win_90, g.nearest, "
        "total_charge / nullif(distinct_bens, 0) AS total_charge_pb, nurse_visit_ct / nullif(distinct_bens, 0) AS nurse_visit_ct_pb, "
        "(total_charge - nurse_visit_ct) / nullif(distinct_bens, 0) AS charge_less_visits_pb, "
        + ", ".join(f"{s}_TBV / (1 + 0.01 * {s}_BBV) AS {s}_ADJ" for s in stems) + ", "
        + f"{_RE} AS RATING_EST, "
        + ", ".join(f"{s}_BBV / nullif({s}_TBV, 0) AS {s}_BTR_RAW" for s in stems) + ", "
        + "EMO_REL_TBV AS MANAGED_EMO_REL, " + ", ".join(f"{s}_TBV + {s}_MBV AS MANAGED_{s}" for s in S.MANAGED_STEMS) + ", "
        + "CAST(coalesce(CAST(m.ownership = 'For-Profit' AS INTEGER), 0) AS INTEGER) AS for_profit, "
        + f"{_WR} AS would_recommend "
        "FROM merged m LEFT JOIN g_gf g ON m.lat = g.lat AND m.lng = g.lng)"
    )
    st = "st AS (SELECT " + ", ".join(f"min({s}_BTR_RAW) AS mn_{s}, max({s}_BTR_RAW) AS mx_{s}" for s in stems) + " FROM f1)"
    dummies = [(f"ownership_{v}", f"CAST(coalesce(CAST(ownership = '{v}' AS INTEGER), 0) AS INTEGER)") for v in OWNERSHIP_LEVELS]
    dummies += [(f"care_home_{v}", f"CAST(coalesce(CAST(care_home = '{v}' AS INTEGER), 0) AS INTEGER)") for v in CARE_LEVELS]
    ints = {"days_operation", "n_win_30", "n_win_60", "n_win_90", "for_profit"}
    text = {"ccn", "name", "address", "city", "state", "zip", "county"}
    plain = keep + list(S.DEMOGRAPHIC_COLUMNS) + ["perc_nonwhite"] + Q.GEO_OUT + [
        "total_charge_pb", "nurse_visit_ct_pb", "charge_less_visits_pb"
    ] + [f"{s}_ADJ" for s in stems] + ["RATING_EST", "MANAGED_EMO_REL"] + [f"MANAGED_{s}" for s in S.MANAGED_STEMS] + [
        "for_profit", "would_recommend"
    ]
    sel = [Q.q(c) if (c in ints or c in text) else f"{R(Q.q(c))} AS {Q.q(c)}" for c in plain]
    sel += [
        R(f"1 - ({s}_BTR_RAW - mn_{s}) / (CASE WHEN mx_{s} - mn_{s} = 0 THEN 1 ELSE mx_{s} - mn_{s} END)") + f" AS {s}_BTR" for s in stems
    ]
    sel += [f"{e} AS {Q.q(n)}" for n, e in dummies]
    return Q.radius_ctes("merged") + ",\n" + f1 + ",\n" + st, "SELECT " + ", ".join(sel) + " FROM f1 CROSS JOIN st"


_FEAT_CTES, _FEAT_SELECT = _features_sql()


def features_table(spark, sf_dir) -> DataFrame:
    return jobs.all_features(merged(spark, sf_dir), dummy_levels={"ownership": OWNERSHIP_LEVELS, "care_home": CARE_LEVELS})


@register("all_features", _merged_sql(_FEAT_SELECT, _FEAT_CTES))
def q_all_features(spark, sf_dir):
    return r6(flat_geo(features_table(spark, sf_dir)))


def _variable_summary_parts():
    flat = [c for c in Q.MERGED_COLUMNS if c != "ccn"]
    sources = [
        ("survey", list(S.SURVEY_CODES)),
        ("provider", [c for c in S.PROVIDER_ID_COLUMNS if c != "ccn"] + S.PROVIDER_FLOATS + ["lat", "lng"]),
        ("facility", ["ownership", "care_home", "days_operation"]),
        ("usage", [m for m in S.USAGE_MEASURES] + list(S.DEMOGRAPHIC_COLUMNS)),
    ]
    descriptions = [("provider", S.PROVIDER_DESCRIPTIONS), ("survey", S.SURVEY_DESCRIPTIONS), ("usage", S.USAGE_DESCRIPTIONS)]
    return flat, sources, descriptions


def _variable_summary_sql() -> str:
    flat, sources, descriptions = _variable_summary_parts()

    def src(v):
        for name, cols in sources:
            if v in cols:
                return name
        return sources[-1][0]

    def desc(v):
        for _, d in descriptions:
            if v in d:
                return d[v]
        return ""

    rows = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {i} AS position, '{src(v)}' AS source, '{desc(v).replace(chr(39), chr(39) * 2)}' AS description, "
        + R(f"avg(CASE WHEN {Q.q(v)} IS NULL THEN 1.0 ELSE 0.0 END)") + " AS TOTAL, "
        + ", ".join(
            R(f"avg(CASE WHEN {t} IS NOT NULL THEN (CASE WHEN {Q.q(v)} IS NULL THEN 1.0 ELSE 0.0 END) END)") + f" AS {t}"
            for t in S.SENTIMENT_COLUMNS
        )
        + " FROM merged"
        for i, v in enumerate(flat)
    )
    return _merged_sql(rows)


@register("variable_summary", _variable_summary_sql())
def q_variable_summary(spark, sf_dir):
    m = flat_geo(merged(spark, sf_dir))
    flat, sources, descriptions = _variable_summary_parts()
    return r6(profile_variable_summary(spark, m, flat, sources, descriptions))


def profile_variable_summary(spark, m: DataFrame, columns, sources, descriptions) -> DataFrame:
    """E6: catalog (D6) ⋈ TOTAL missing fraction (E4) ⋈ conditional matrix (E5); one pass over
    the merged table for all the fractions (it is persisted by the caller when reused)."""
    catalog = merge.variable_catalog(spark, sources, descriptions, columns)
    fractions = profile.missing_summary(m, columns, S.SENTIMENT_COLUMNS, total="TOTAL")
    return catalog.join(fractions, "variable")


# --------------------------------------------------------------------------------------------
# J. Sampling, transformers, kNN, models
# --------------------------------------------------------------------------------------------

from ..models import leastsquares, regress  # noqa: E402
from ..models.scaler import NullAwareStandardScaler  # noqa: E402
from ..operators import knn, sampling  # noqa: E402

_X = S.FEATURES_NUM
_SPLIT_SQL = (
    "SELECT *, CASE WHEN row_number() OVER (PARTITION BY state ORDER BY md5(ccn || '|42')) <= "
    "(CASE WHEN count(*) OVER (PARTITION BY state) <= 1 THEN 0 ELSE ceil(0.33 * count(*) OVER (PARTITION BY state)) END) "
    "THEN 'test' ELSE 'train' END AS part FROM features_num"
)


def split_table(spark, sf_dir) -> DataFrame:
    return sampling.stratified_split(sh.features_num(spark, sf_dir), "state", "ccn")


@register("stratified_split", Q.with_all(f"sp AS ({_SPLIT_SQL})", "SELECT ccn, state, part FROM sp", "features_num"))
def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("ccn", "state", "part")


@register(
    "select_xy",
    Q.with_all(f"sp AS ({_SPLIT_SQL})", "SELECT ccn, x1, x2, y1 FROM sp WHERE part = 'train' AND y1 IS NOT NULL", "features_num"),
)
def q_select_xy(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    return r6(sampling.select_xy(sp, (F.col("part") == "train") & F.col("y1").isNotNull(), ["ccn", "x1", "x2"], "y1"))


def _scale_sql(inverse: bool = False) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _X)
    if inverse:
        cols = ", ".join(f"{R(f'(({c} - m_{c}) / s_{c}) * s_{c} + m_{c}')} AS {c}" for c in _X)
    else:
        cols = ", ".join(f"{R(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in _X)
    return Q.with_all(
        f"sp AS ({_SPLIT_SQL}), st AS (SELECT {stats} FROM sp WHERE part = 'train')",
        f"SELECT ccn, {cols} FROM sp CROSS JOIN st",
        "features_num",
    )


def fitted_scaler(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    model = NullAwareStandardScaler(inputCols=_X).fit(sp.where(F.col("part") == "train"))
    return sp, model


@register("standard_scale", _scale_sql())
def q_standard_scale(spark, sf_dir):
    sp, model = fitted_scaler(spark, sf_dir)
    return r6(model.transform(sp).select("ccn", *_X))


@register("inverse_scale", _scale_sql(inverse=True))
def q_inverse_scale(spark, sf_dir):
    sp, model = fitted_scaler(spark, sf_dir)
    return r6(model.inverse(model.transform(sp)).select("ccn", *_X))


@register(
    "reverse_minmax",
    Q.with_all(
        "st AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _X) + " FROM features_num)",
        "SELECT ccn, "
        + ", ".join(R(f"1 - ({c} - mn_{c}) / (CASE WHEN mx_{c} - mn_{c} = 0 THEN 1 ELSE mx_{c} - mn_{c} END)") + f" AS {c}" for c in _X)
        + " FROM features_num CROSS JOIN st",
        "features_num",
    ),
)
def q_reverse_minmax(spark, sf_dir):
    return r6(features.reverse_minmax(sh.features_num(spark, sf_dir).select("ccn", *_X), _X))


def _knn_pairs_sql(features, src_q: str, src_d: str, group_cols) -> str:
    """Brute-force candidate pairs with the NaN-aware distance (oracle only)."""
    p = len(features)
    shared = " + ".join(f"(CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END)" for c in features)
    ss = " + ".join(f"coalesce(pow(q.{c} - d.{c}, 2), 0)" for c in features)
    grp = ", ".join(group_cols)
    return (
        f"dg AS (SELECT *, min(ccn) OVER (PARTITION BY {grp}) AS gk FROM {src_d}), "
        f"pr AS (SELECT q.ccn AS qk, d.ccn AS dk, d.gk, " + ", ".join(f"d.{c} AS d_{c}" for c in group_cols)
        + f", {shared} AS sh, {ss} AS ss FROM {src_q} q JOIN dg d ON ({shared}) > 0), "
        f"pd AS (SELECT *, sqrt({float(p)} / sh * ss) AS dist FROM pr)"
    )


def _knn_impute_sql(k: int = S.KNN_IMPUTE_K) -> str:
    items = " UNION ALL ".join(
        f"SELECT pd.qk, '{c}' AS target, pd.d_{c} AS tv, pd.dist, pd.gk, pd.dk FROM pd JOIN q ON pd.qk = q.ccn "
        f"WHERE q.{c} IS NULL AND pd.d_{c} IS NOT NULL"
        for c in _X
    )
    ctes = (
        "q AS (SELECT * FROM features_num WHERE " + " OR ".join(f"{c} IS NULL" for c in _X) + "), "
        + _knn_pairs_sql(_X, "q", "features_num", _X)
        + f", it AS ({items}), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY qk, target ORDER BY dist, gk, dk) AS rn FROM it), "
        f"im AS (SELECT qk, target, avg(tv) AS v, count(*) AS n FROM rk WHERE rn <= {k} GROUP BY qk, target), "
        "mu AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}" for c in _X) + " FROM features_num)"
    )
    return ctes


@register(
    "knn_impute",
    Q.with_all(
        _knn_impute_sql(),
        "SELECT f.ccn, "
        + ", ".join(
            R(f"coalesce(f.{c}, (SELECT v FROM im WHERE im.qk = f.ccn AND im.target = '{c}'), mu_{c})") + f" AS {c}" for c in _X
        )
        + " FROM features_num f CROSS JOIN mu",
        "features_num",
    ),
)
def q_knn_impute(spark, sf_dir):
    f = sh.features_num(spark, sf_dir).select("ccn", *_X)
    return r6(knn.knn_impute(f, f, "ccn", _X, k=S.KNN_IMPUTE_K))


@register("knn_join", Q.with_all(_knn_impute_sql(), "SELECT qk AS ccn, target, (round(v, 6) + 0.0) AS value, CAST(n AS BIGINT) AS n_donors FROM im", "features_num"))
def q_knn_join(spark, sf_dir):
    """D8 itself: per (row, missing feature) the mean over its k nearest donors and their count."""
    f = sh.features_num(spark, sf_dir).select("ccn", *_X)
    need = {c: F.col(c).isNull() for c in _X}
    return r6(knn.knn_target_means(f, f, "ccn", _X, _X, need, S.KNN_IMPUTE_K))


_DENSE = S.FEATURES_DENSE


@register(
    "knn_regress",
    Q.with_all(
        f"sp AS ({_SPLIT_SQL}), tr AS (SELECT ccn, x1, x2, y1 FROM sp WHERE part = 'train' AND y1 IS NOT NULL), "
        "te AS (SELECT ccn, x1, x2, y1 FROM sp WHERE part = 'test' AND y1 IS NOT NULL), "
        + _knn_pairs_sql(_DENSE, "te", "tr", ["x1", "x2", "y1"])
        + f", rk AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY dist, gk, dk) AS rn FROM pd)",
        f"SELECT te.ccn, te.y1, round((SELECT avg(d_y1) FROM rk WHERE rk.qk = te.ccn AND rn <= {S.KNN_REGRESS_K}), 6) AS prediction FROM te",
        "features_num",
    ),
)
def q_knn_regress(spark, sf_dir):
    sp = split_table(spark, sf_dir).where(F.col("y1").isNotNull())
    train = sp.where(F.col("part") == "train").select("ccn", *_DENSE, "y1")
    test = sp.where(F.col("part") == "test").select("ccn", *_DENSE, "y1")
    return r6(knn.knn_regress(test, train, "ccn", _DENSE, "y1", k=S.KNN_REGRESS_K).select("ccn", "y1", "prediction"))


def _u_sql(key_expr: str, seed: int = S.DEFAULT_SEED) -> str:
    return f"(CAST(('0x' || substr(md5({key_expr} || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0)"


def _inject_sql(c: str) -> str:
    u = _u_sql(f"ccn || '|{c}'")
    return R(f"CASE WHEN {u} < r_{c} THEN NULL ELSE {c} END") + f" AS {c}"


@register(
    "simulate_missing",
    Q.with_all(
        "rt AS (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS r_{c}" for c in _X)
        + " FROM features_num WHERE y1 IS NULL)",
        "SELECT ccn, "
        + ", ".join(_inject_sql(c) for c in _X)
        + " FROM features_num CROSS JOIN rt WHERE y1 IS NOT NULL",
        "features_num",
    ),
)
def q_simulate_missing(spark, sf_dir):
    f = sh.features_num(spark, sf_dir)
    rates = sampling.missing_rates(f.where(F.col("y1").isNull()), _X)
    return r6(sampling.inject_missing(f.where(F.col("y1").isNotNull()), rates).select("ccn", *_X))


def _ols2_sql(src: str, y: str = "y1", p: str = "") -> str:
    """Closed-form OLS of ``y`` on (x1, x2) with intercept, from population covariances
    (CTEs ``{p}cv``, ``{p}co``, ``{p}coef``)."""
    return (
        f"{p}cv AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg({y}) AS my, var_pop(x1) AS v11, var_pop(x2) AS v22, "
        f"covar_pop(x1, x2) AS v12, covar_pop(x1, {y}) AS c1, covar_pop(x2, {y}) AS c2 FROM {src} WHERE {y} IS NOT NULL), "
        f"{p}co AS (SELECT (v22 * c1 - v12 * c2) / (v11 * v22 - v12 * v12) AS b1, (v11 * c2 - v12 * c1) / (v11 * v22 - v12 * v12) AS b2, "
        f"m1, m2, my FROM {p}cv), {p}coef AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM {p}co)"
    )


_TRAIN_SQL = f"sp AS ({_SPLIT_SQL}), tr AS (SELECT * FROM sp WHERE part = 'train' AND y1 IS NOT NULL), te AS (SELECT * FROM sp WHERE part = 'test' AND y1 IS NOT NULL)"


@register(
    "linear_fit",
    Q.with_all(
        _TRAIN_SQL + ", " + _ols2_sql("tr"),
        "SELECT 'intercept' AS feature, (round(b0, 6) + 0.0) AS coefficient FROM coef UNION ALL SELECT 'x1', round(b1, 6) FROM coef "
        "UNION ALL SELECT 'x2', round(b2, 6) FROM coef",
        "features_num",
    ),
)
def q_linear_fit(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    train = sp.where((F.col("part") == "train") & F.col("y1").isNotNull())
    return r6(leastsquares.coefficient_table(spark, leastsquares.fit(train, _DENSE, "y1")[0]))


@register(
    "regression_metrics",
    Q.with_all(
        _TRAIN_SQL + ", " + _ols2_sql("tr") + ", pr AS (SELECT te.y1, b0 + b1 * te.x1 + b2 * te.x2 AS p FROM te CROSS JOIN coef), "
        "ag AS (SELECT count(*) AS n, sum(pow(y1 - p, 2)) AS sse, sum(abs(y1 - p)) AS sae, avg(y1) AS my FROM pr), "
        "tt AS (SELECT sum(pow(pr.y1 - ag.my, 2)) AS sst FROM pr CROSS JOIN ag)",
        "SELECT CAST(n AS BIGINT) AS n, (round(1 - sse / sst, 6) + 0.0) AS r2, (round(sse / n, 6) + 0.0) AS mse, (round(sqrt(sse / n), 6) + 0.0) AS rmse, "
        "(round(sae / n, 6) + 0.0) AS mae FROM ag CROSS JOIN tt",
        "features_num",
    ),
)
def q_regression_metrics(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    train = sp.where((F.col("part") == "train") & F.col("y1").isNotNull())
    test = sp.where((F.col("part") == "test") & F.col("y1").isNotNull())
    model = regress.fit_linear(train, _DENSE, "y1")
    coefs = {"intercept": model.intercept, **dict(zip(_DENSE, model.coefficients.toArray()))}
    pred = test.withColumn("prediction", regress.linear_prediction(coefs, _DENSE))
    return r6(regress.metrics(pred, "y1"))


# --------------------------------------------------------------------------------------------
# F / K / L. Dashboard answers for all entities at once
# --------------------------------------------------------------------------------------------

from ..operators import distribution, insight  # noqa: E402


def _survey_long_clean(spark, sf_dir) -> DataFrame:
    return reshape.unpivot_numeric(jobs.clean_survey(sh.survey_long(spark, sf_dir)), ["ccn"], S.SURVEY_CODES)


_SURVEY_UNPIVOT_SQL = "sl AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT ccn, '{c}' AS variable, {c} AS value FROM w" for c in S.SURVEY_CODES
) + ") WHERE value IS NOT NULL)"


def _top_bottom_sql(src: str, entity: str, item: str, score: str, n: int = 3) -> str:
    return (
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {score} DESC, {item} ASC) AS rd, "
        f"row_number() OVER (PARTITION BY {entity} ORDER BY {score} ASC, {item} DESC) AS ra FROM {src}), "
        f"tb AS (SELECT {entity}, max(CASE WHEN rd = 1 THEN {item} END) AS best, max(CASE WHEN rd = 1 THEN {score} END) AS best_score, "
        f"max(CASE WHEN ra = 1 THEN {item} END) AS worst, max(CASE WHEN ra = 1 THEN {score} END) AS worst_score, "
        f"string_agg({item}, '|' ORDER BY ra) FILTER (WHERE ra <= {n}) AS worst_items, "
        f"sum(CASE WHEN ra <= {n} THEN {score} END) AS worst_sum FROM rk GROUP BY {entity})"
    )


_TB_SELECT = (
    "SELECT {e}, best, (round(best_score, 6) + 0.0) AS best_score, worst, (round(worst_score, 6) + 0.0) AS worst_score, worst_items, "
    "(round(worst_sum, 6) + 0.0) AS worst_sum, CASE WHEN worst_sum > 0 THEN 'raised' ELSE 'lowered' END AS direction{extra} FROM tb"
)


@register(
    "driver_top_bottom",
    Q.with_all(f"w AS ({Q.clean_survey()}), " + _SURVEY_UNPIVOT_SQL + ", " + _top_bottom_sql("sl", "ccn", "variable", "value"),
               _TB_SELECT.format(e="ccn", extra=""), "survey_long"),
)
def q_driver_top_bottom(spark, sf_dir):
    return r6(insight.driver_top_bottom(_survey_long_clean(spark, sf_dir), "ccn", "variable", "value"))


def resolved_scores(spark, sf_dir) -> DataFrame:
    pred = sh.predictions(spark, sf_dir).select("ccn", F.col("would_recommend").alias("y1"), F.col("rating_est").alias("y2"))
    f = sh.features_num(spark, sf_dir)
    return merge.resolve_scores(f, pred, ["y1", "y2"]).join(f.select("ccn", "state"), "ccn")


_RESOLVED_CTE = (
    "rs AS (SELECT f.ccn, f.state, CASE WHEN p.ccn IS NOT NULL THEN p.would_recommend ELSE f.y1 END AS y1, "
    "CASE WHEN p.ccn IS NOT NULL THEN p.rating_est ELSE f.y2 END AS y2 FROM features_num f LEFT JOIN predictions p ON f.ccn = p.ccn)"
)


@register(
    "entity_standing",
    Q.with_all(
        _RESOLVED_CTE,
        "SELECT ccn, state, y1, (round(percent_rank() OVER (PARTITION BY state ORDER BY y1), 6) + 0.0) AS group_percent_rank, "
        "(round(cume_dist() OVER (PARTITION BY state ORDER BY y1), 6) + 0.0) AS group_cume_dist, "
        "(round(percent_rank() OVER (ORDER BY y1), 6) + 0.0) AS nation_percent_rank, (round(cume_dist() OVER (ORDER BY y1), 6) + 0.0) AS nation_cume_dist "
        "FROM rs WHERE y1 IS NOT NULL",
        "features_num",
        "predictions",
    ),
)
def q_entity_standing(spark, sf_dir):
    return r6(insight.entity_standing(resolved_scores(spark, sf_dir), "ccn", "state", "y1"))


@register(
    "hist_by_width",
    Q.with_all(
        _RESOLVED_CTE + ", v AS (SELECT state, y1 AS x FROM rs WHERE y1 IS NOT NULL), "
        "g AS (SELECT state, min(x) AS mn, count(*) AS n FROM v GROUP BY state), a AS (SELECT min(x) AS mn, count(*) AS n FROM v)",
        "SELECT 'state' AS scope, v.state, CAST(floor((x - g.mn) / 1.0) AS BIGINT) AS bin, round(g.mn + floor((x - g.mn) / 1.0) * 1.0, 6) AS bin_start, "
        "CAST(count(*) AS BIGINT) AS count, (round(count(*) / (g.n * 1.0), 6) + 0.0) AS density FROM v JOIN g ON v.state = g.state "
        "GROUP BY v.state, g.mn, g.n, floor((x - g.mn) / 1.0) "
        "UNION ALL SELECT 'national', NULL, CAST(floor((x - a.mn) / 1.0) AS BIGINT), round(a.mn + floor((x - a.mn) / 1.0) * 1.0, 6), "
        "CAST(count(*) AS BIGINT), round(count(*) / (a.n * 1.0), 6) FROM v CROSS JOIN a GROUP BY a.mn, a.n, floor((x - a.mn) / 1.0)",
        "features_num",
        "predictions",
    ),
)
def q_hist_by_width(spark, sf_dir):
    return r6(distribution.hist_by_width(resolved_scores(spark, sf_dir), "y1", 1.0, "state"))


def _hist_count_sql(bins: int) -> str:
    width = f"(CASE WHEN mx = mn THEN 1.0 ELSE (mx - mn) / {bins} END)"
    return Q.with_all(
        f"w AS ({Q.clean_survey()}), " + _SURVEY_UNPIVOT_SQL
        + ", st AS (SELECT variable, min(value) AS mn, max(value) AS mx, count(*) AS n FROM sl GROUP BY variable), "
        f"b AS (SELECT sl.variable, mn, mx, n, CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / (mx - mn) * {bins}), {bins - 1}) END AS bin "
        "FROM sl JOIN st ON sl.variable = st.variable)",
        f"SELECT variable, CAST(bin AS INTEGER) AS bin, round(mn + bin * {width}, 6) AS bin_start, "
        f"CAST(count(*) AS BIGINT) AS count, round(count(*) / (n * {width}), 6) AS density "
        "FROM b GROUP BY variable, bin, mn, mx, n",
        "survey_long",
    )


def _hist_count(bins: int):
    return lambda spark, sf_dir: r6(distribution.hist_by_count(_survey_long_clean(spark, sf_dir), "variable", "value", bins))


for _key, _bins in (("hist_by_count", 10), ("hist_by_count_12", 12), ("hist_by_count_20", 20)):
    register(_key, _hist_count_sql(_bins))(_hist_count(_bins))


@register(
    "kde_curve",
    Q.with_all(
        _RESOLVED_CTE + ", v AS (SELECT y2 AS x FROM rs WHERE y2 IS NOT NULL), "
        "st AS (SELECT min(x) AS mn, max(x) AS mx, count(*) AS n, stddev_samp(x) AS sd FROM v), "
        "pr AS (SELECT mn, mx, n, sd * pow(n, -1.0 / 5.0) AS h, (mx - mn) / 99.0 AS step FROM st), "
        "wv AS (SELECT x, count(*) AS w FROM v GROUP BY x), gp AS (SELECT range AS point FROM range(0, 100))",
        "SELECT CAST(point AS INTEGER) AS point, (round(mn + point * step, 6) + 0.0) AS x, "
        "round(sum(w * exp(-0.5 * pow(((mn + point * step) - x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density "
        "FROM gp CROSS JOIN wv CROSS JOIN pr GROUP BY point, mn, step, n, h",
        "features_num",
        "predictions",
    ),
)
def q_kde_curve(spark, sf_dir):
    return r6(distribution.kde_curve(resolved_scores(spark, sf_dir), "y2", 100))


def _curves_sql(cells: int = distribution.SKETCH_CELLS) -> str:
    return Q.with_all(
        _RESOLVED_CTE + ", v AS (SELECT 'state' AS scope, state, y2 AS x FROM rs WHERE y2 IS NOT NULL UNION ALL SELECT 'national', NULL, y2 FROM rs WHERE y2 IS NOT NULL), "
        "s0 AS (SELECT scope, state, min(x) AS mn, max(x) AS mx, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd FROM v GROUP BY scope, state), "
        f"st AS (SELECT scope, state, mn, n, (mx - mn) / {cells}.0 AS cell, (mx - mn) / 99.0 AS step, (CASE WHEN sd < 1e-9 THEN 1.0 ELSE sd END) * pow(n, -0.2) AS h FROM s0), "
        "p AS (SELECT v.scope, v.state, CASE WHEN cell > 0 THEN (x - mn) / cell ELSE 0 END AS p FROM v JOIN st ON v.scope = st.scope AND v.state IS NOT DISTINCT FROM st.state), "
        "sk AS (SELECT scope, state, node, sum(share) AS w FROM (SELECT scope, state, floor(p) AS node, 1 - (p - floor(p)) AS share FROM p "
        "UNION ALL SELECT scope, state, floor(p) + 1, p - floor(p) FROM p) GROUP BY scope, state, node), gp AS (SELECT range AS point FROM range(0, 100))",
        "SELECT st.scope, st.state, CAST(point AS INTEGER) AS point, (round(mn + point * step, 6) + 0.0) AS x, "
        "round(sum(w * exp(-0.5 * pow((point * step - node * cell) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density "
        "FROM st JOIN sk ON st.scope = sk.scope AND st.state IS NOT DISTINCT FROM sk.state CROSS JOIN gp GROUP BY st.scope, st.state, point, mn, step, n, h",
        "features_num",
        "predictions",
    )


@register("kde_curves", _curves_sql())
def q_kde_curves(spark, sf_dir):
    """L3: the nation's and every state's density from binned sketches."""
    return r6(distribution.density_curves(resolved_scores(spark, sf_dir), "y2", "state"))


# Insight model: y1 on the standardised dense features (scaler fitted on the training rows).

_INSIGHT_SQL = (
    _TRAIN_SQL + ", zs AS (SELECT avg(x1) AS zm1, stddev_pop(x1) AS zs1, avg(x2) AS zm2, stddev_pop(x2) AS zs2 FROM tr), "
    "trz AS (SELECT (x1 - zm1) / zs1 AS x1, (x2 - zm2) / zs2 AS x2, y1 FROM tr CROSS JOIN zs), " + _ols2_sql("trz")
)


def insight_model(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    train = sp.where((F.col("part") == "train") & F.col("y1").isNotNull())
    scaler = NullAwareStandardScaler(inputCols=_DENSE).fit(train)
    lr = regress.fit_linear(scaler.transform(train), _DENSE, "y1")
    coefs = {"intercept": float(lr.intercept), **{f: float(c) for f, c in zip(_DENSE, lr.coefficients.toArray())}}
    return sp, scaler, coefs


@register(
    "coefficient_table",
    Q.with_all(
        _INSIGHT_SQL,
        f"SELECT 'x1' AS feature, '{S.FEATURE_LABELS['x1']}' AS label, (round(b1, 6) + 0.0) AS coefficient FROM coef UNION ALL "
        f"SELECT 'x2', '{S.FEATURE_LABELS['x2']}', round(b2, 6) FROM coef",
        "features_num",
    ),
)
def q_coefficient_table(spark, sf_dir):
    _, _, coefs = insight_model(spark, sf_dir)
    return r6(insight.coefficient_table(spark, coefs, {f: S.FEATURE_LABELS[f] for f in _DENSE}))


_CONTRIB_SQL = (
    _INSIGHT_SQL + ", mu AS (SELECT avg(x1) AS mu1, avg(x2) AS mu2 FROM features_num), "
    "ent AS (SELECT f.* FROM features_num f WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.ccn = f.ccn)), "
    f"ct AS (SELECT ccn, 'x1' AS feature, '{S.FEATURE_LABELS['x1']}' AS label, x1 AS your_score, mu1 AS mean_score, b1 AS coefficient, "
    "(x1 - zm1) / zs1 AS z FROM ent CROSS JOIN zs CROSS JOIN coef CROSS JOIN mu UNION ALL "
    f"SELECT ccn, 'x2', '{S.FEATURE_LABELS['x2']}', x2, mu2, b2, (x2 - zm2) / zs2 FROM ent CROSS JOIN zs CROSS JOIN coef CROSS JOIN mu), "
    "cc AS (SELECT *, coefficient * z AS contribution FROM ct)"
)


def contributions_table(spark, sf_dir):
    sp, scaler, coefs = insight_model(spark, sf_dir)
    labelled = {f: S.FEATURE_LABELS[f] for f in _DENSE}
    entities = sp.join(sh.predictions(spark, sf_dir).select("ccn"), "ccn", "left_anti")  # K5: observed entities only
    coef_df = insight.coefficient_table(spark, coefs, labelled)
    means = insight.column_means(sp, _DENSE)
    raw = {f: f"_raw_{f}" for f in _DENSE}
    contrib = insight.contributions(scaler.transform(entities.withColumns({r: F.col(f) for f, r in raw.items()})), raw, "ccn", coef_df, means)
    return entities, coefs, contrib, scaler


@register(
    "contributions",
    Q.with_all(
        _CONTRIB_SQL,
        "SELECT ccn, feature, label, (round(your_score, 6) + 0.0) AS your_score, (round(mean_score, 6) + 0.0) AS mean_score, "
        "(round(coefficient, 6) + 0.0) AS coefficient, (round(z, 6) + 0.0) AS z, (round(contribution, 6) + 0.0) AS contribution FROM cc",
        "features_num",
        "predictions",
    ),
)
def q_contributions(spark, sf_dir):
    _, _, contrib, _ = contributions_table(spark, sf_dir)
    return r6(contrib.select("ccn", "feature", "label", "your_score", "mean_score", "coefficient", "z", "contribution"))


@register(
    "recommendations",
    Q.with_all(
        _CONTRIB_SQL + ", " + _top_bottom_sql("cc", "ccn", "label", "contribution")
        + ", pd AS (SELECT e.ccn, round_even(b0 + b1 * (e.x1 - zm1) / zs1 + b2 * (e.x2 - zm2) / zs2, 2) AS predicted, "
        "round_even(e.y1, 2) AS actual FROM ent e CROSS JOIN zs CROSS JOIN coef)",
        _TB_SELECT.format(e="tb.ccn", extra=", (round(pd.predicted, 6) + 0.0) AS predicted, (round(pd.actual, 6) + 0.0) AS actual").replace(
            " FROM tb", " FROM tb LEFT JOIN pd ON tb.ccn = pd.ccn"
        ),
        "features_num",
        "predictions",
    ),
)
def q_recommendations(spark, sf_dir):
    entities, coefs, contrib, scaler = contributions_table(spark, sf_dir)
    z = scaler.transform(entities.select("ccn", *_DENSE, "y1"))
    predicted = z.select("ccn", regress.linear_prediction(coefs, _DENSE).alias("predicted"), F.col("y1").alias("actual"))
    return r6(insight.recommendations(contrib, "ccn", _DENSE, predicted))


# --------------------------------------------------------------------------------------------
# J5-J17 model operators, A5 model persistence, P7-P9 model jobs
# --------------------------------------------------------------------------------------------

from ..models import boosting, evaluate  # noqa: E402
from ..models.imputer import KnnImputer  # noqa: E402
from ..sources.files import export_csv as _export_csv  # noqa: E402


def preprocessing(features=_X, key: str = "ccn", *more, exclude=()):
    """J6: the pipeline scaler -> kNN imputer -> further stages; columns in ``exclude`` are not scaled."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=[NullAwareStandardScaler(inputCols=list(features), excludeCols=list(exclude)), KnnImputer(inputCols=list(features), keyCol=key), *more])


def scale_impute(train: DataFrame, others: DataFrame, features=_X, key: str = "ccn"):
    """J6 fitted on ``train``; both tables are transformed in one search. A row may be in both tables."""
    model = preprocessing(features, key).fit(train)
    both = train.withColumn("_side", F.lit(0)).unionByName(others.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    done = cut_lineage_df(model.transform(both))
    return done.where("_side = 0").select(*train.columns), done.where("_side = 1").select(*others.columns), model


def _train_test(spark, sf_dir, label="y1"):
    sp = split_table(spark, sf_dir).where(F.col(label).isNotNull())
    return sp.where(F.col("part") == "train"), sp.where(F.col("part") == "test")


def _scaled_imputed_sql(select: str, k: int = S.KNN_IMPUTE_K, exclude=()) -> str:
    """Brute force: all rows scaled by the labelled training rows' statistics, gaps from the nearest of those rows."""
    items = " UNION ALL ".join(
        f"SELECT pd.qk, '{c}' AS target, pd.d_{c} AS tv, pd.dist, pd.gk, pd.dk FROM pd JOIN q ON pd.qk = q.ccn WHERE q.{c} IS NULL AND pd.d_{c} IS NOT NULL" for c in _X
    )
    raw = {c: f"coalesce(z.{c}, (SELECT v FROM im WHERE im.qk = z.ccn AND im.target = '{c}'), mu_{c})" for c in _X}
    filled = ", ".join(R(v) + f" AS {c}" for c, v in raw.items())
    unrounded = ", ".join(f"{v} AS {c}" for c, v in raw.items())
    return Q.with_all(
        _TRAIN_SQL
        + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _X) + " FROM tr), "
        "z AS (SELECT ccn, part, y1, " + ", ".join(c if c in exclude else f"({c} - m_{c}) / s_{c} AS {c}" for c in _X) + " FROM sp CROSS JOIN st), "
        "zd AS (SELECT * FROM z WHERE part = 'train' AND y1 IS NOT NULL), "
        "q AS (SELECT * FROM z WHERE " + " OR ".join(f"{c} IS NULL" for c in _X) + "), "
        + _knn_pairs_sql(_X, "q", "zd", _X)
        + f", it AS ({items}), rk AS (SELECT *, row_number() OVER (PARTITION BY qk, target ORDER BY dist, gk, dk) AS rn FROM it), "
        f"im AS (SELECT qk, target, avg(tv) AS v FROM rk WHERE rn <= {k} GROUP BY qk, target), "
        "mu AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}" for c in _X) + " FROM zd)",
        select.format(filled=filled, unrounded=unrounded),
        "features_num",
    )


@register("scale_impute", _scaled_imputed_sql("SELECT z.ccn, z.part, {filled} FROM z CROSS JOIN mu"))
def q_scale_impute(spark, sf_dir):
    """J6, A5: scaler and imputer fitted on the labelled training rows, saved, read again, applied to all raw rows."""
    sp = split_table(spark, sf_dir).select("ccn", "part", "y1", *_X)
    model = preprocessing().fit(sp.where((F.col("part") == "train") & F.col("y1").isNotNull()))
    return r6(_reloaded(spark, model, "preprocessing").transform(sp).select("ccn", "part", *_X))


@register("boosted_fit_predict")
def q_boosted_fit_predict(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    tr, te, _ = scale_impute(train.select("ccn", *_X, "y1"), test.select("ccn", *_X, "y1"))
    model = boosting.grow(tr, _X, "y1")[0, 0]
    return r6(boosting.predict(te, {0: model}, _X).select("ccn", "y1", "prediction"))


def _stacked_train(spark, sf_dir, label="y1"):
    train, _ = _train_test(spark, sf_dir, label)
    rows = train.select("ccn", *_X, label)
    return evaluate.scale_impute_stacked(evaluate.stack_folds(rows, "ccn"), "ccn", _X)


@register("random_search")
def q_random_search(spark, sf_dir):
    return r6(evaluate.random_search(_stacked_train(spark, sf_dir), _X, "y1"))


def _cv_report(spark, sf_dir) -> DataFrame:
    """Linear against quantile boosting for both targets, cross-validated on the training rows."""
    out = None
    for y in S.TARGETS:
        train, _ = _train_test(spark, sf_dir, y)
        rows = evaluate.cv_compare(train.select("ccn", *_X, y), "ccn", _X, y).withColumn("target", F.lit(y))
        out = rows if out is None else out.unionByName(rows)
    return out


def _resample_report(spark, sf_dir) -> DataFrame:
    """Linear, kNN and boosted models for both targets on the training rows' random splits, one row for each
    split; the missing rates are those of the rows without a label."""
    out = None
    for y in S.TARGETS:
        sp = split_table(spark, sf_dir)
        rows = sp.where((F.col("part") == "train") & F.col(y).isNotNull()).unionByName(sp.where(F.col(y).isNull())).select("ccn", *_X, y)
        found = evaluate.resample_eval(rows, "ccn", _X, y).withColumn("target", F.lit(y))
        out = found if out is None else out.unionByName(found)
    return out


@register("cv_compare")
def q_cv_compare(spark, sf_dir):
    return r6(_cv_report(spark, sf_dir))


@register("resample_eval")
def q_resample_eval(spark, sf_dir):
    return r6(_resample_report(spark, sf_dir))


def _score_sql() -> str:
    return Q.with_all(
        _TRAIN_SQL + ", " + _ols2_sql("tr", "y1", "a") + ", " + _ols2_sql("tr", "y2", "b"),
        "SELECT f.ccn, (round(a.b0 + a.b1 * f.x1 + a.b2 * f.x2, 6) + 0.0) AS would_recommend, (round(b.b0 + b.b1 * f.x1 + b.b2 * f.x2, 6) + 0.0) AS rating_est "
        "FROM features_num f CROSS JOIN acoef a CROSS JOIN bcoef b WHERE f.y1 IS NULL",
        "features_num",
    )


def score_unlabelled(models: dict, table: DataFrame, features, unlabelled, key: str = "ccn") -> DataFrame:
    """Predict every target for the rows selected by ``unlabelled`` (a parameter: the reference
    tests one bin column in one place and the derived target in another)."""
    rows = table.where(unlabelled)
    return rows.select(key, *[regress.linear_prediction(c, features).alias(t) for t, c in models.items()])


@register("score_unlabelled", _score_sql())
def q_score_unlabelled(spark, sf_dir):
    sp = split_table(spark, sf_dir)
    train = sp.where(F.col("part") == "train")
    models = {}
    for target, y in (("would_recommend", "y1"), ("rating_est", "y2")):
        lr = regress.fit_linear(train.where(F.col(y).isNotNull()), _DENSE, y)
        models[target] = {"intercept": float(lr.intercept), **dict(zip(_DENSE, map(float, lr.coefficients.toArray())))}
    return r6(score_unlabelled(models, sp, _DENSE, F.col("y1").isNull()))


@register("quantile_boost")
def q_quantile_boost(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    tr, te, _ = scale_impute(train.select("ccn", *_X, "y1"), test.select("ccn", *_X, "y1"))
    model = boosting.grow(tr, _X, "y1", [evaluate.QUANTILE], rounds=S.COMPARE_ROUNDS)[0, 0]
    return r6(boosting.predict(te, {0: model}, _X).select("ccn", "y1", "prediction"))


@register(
    "attribution_linear",
    Q.with_all(
        _INSIGHT_SQL + ", zt AS (SELECT x1, x2 FROM trz), zm AS (SELECT avg(x1) AS a1, avg(x2) AS a2 FROM zt)",
        "SELECT 'x1' AS feature, round(avg(abs(b1 * (x1 - a1))), 6) AS mean_abs_contribution, CASE WHEN b1 >= 0 THEN 1 ELSE -1 END AS direction "
        "FROM zt CROSS JOIN zm CROSS JOIN coef GROUP BY b1 UNION ALL "
        "SELECT 'x2', round(avg(abs(b2 * (x2 - a2))), 6), CASE WHEN b2 >= 0 THEN 1 ELSE -1 END FROM zt CROSS JOIN zm CROSS JOIN coef GROUP BY b2",
        "features_num",
    ),
)
def q_attribution_linear(spark, sf_dir):
    sp, scaler, coefs = insight_model(spark, sf_dir)
    train = sp.where((F.col("part") == "train") & F.col("y1").isNotNull())
    return r6(evaluate.attribution_linear(scaler.transform(train), coefs, _DENSE))


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    tr, te, _ = scale_impute(train.select("ccn", *_X, "y1"), test.select("ccn", *_X, "y1"))
    model = boosting.grow(tr, _X, "y1")[0, 0]
    te = cut_lineage_df(te)
    return r6(evaluate.permutation_importance(te, "ccn", _X, "y1", lambda d: boosting.predict(d, {0: model}, _X)))


@register("attribution_trees")
def q_attribution_trees(spark, sf_dir):
    """J17 for trees: mean |contribution| along the trees' paths, its direction, and the features' shares in the gain."""
    train, _ = _train_test(spark, sf_dir)
    tr, _, _ = scale_impute(train.select("ccn", *_X, "y1"), train.select("ccn", *_X, "y1").limit(0))
    return r6(boosting.attribution(tr, boosting.grow(tr, _X, "y1")[0, 0], _X))


def cut_lineage_df(df: DataFrame) -> DataFrame:
    from ..session import cut_lineage

    return cut_lineage(df)


@register("group_components")
def q_group_components(spark, sf_dir):
    f = sh.features_num(spark, sf_dir).select("ccn", *_X)
    full = knn.knn_impute(f, f, "ccn", _X)
    return r6(evaluate.group_components(full, {"activity": ["x1", "x3"], "profile": ["x2", "x4"]}))


@register("export_training", _scaled_imputed_sql("SELECT " + R("z.y1") + " AS y1, {filled} FROM z CROSS JOIN mu WHERE z.part = 'train' AND z.y1 IS NOT NULL"))
def q_export_training(spark, sf_dir):
    """J7: split -> scale + impute (fit on train) -> CSV with the label first -> read back."""
    train, _ = _train_test(spark, sf_dir)
    tr, _, _ = scale_impute(train.select("ccn", *_X, "y1"), train.select("ccn", *_X, "y1").limit(0))
    path = scratch_path(spark, "training_csv")
    _export_csv(tr.select("y1", *_X), path)
    back = files.scan_csv(spark, path)
    return r6(back.select(*[F.col(c).cast("double").alias(c) for c in back.columns]))


@register(
    "model_roundtrip",
    Q.with_all(
        _TRAIN_SQL + ", " + _ols2_sql("tr"),
        "SELECT te.ccn, te.y1, (round(b0 + b1 * te.x1 + b2 * te.x2, 6) + 0.0) AS prediction FROM te CROSS JOIN coef",
        "features_num",
    ),
)
def q_model_roundtrip(spark, sf_dir):
    """A5: fitted scaler and OLS pipeline saved with Spark ML persistence, loaded, re-applied."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    train, test = _train_test(spark, sf_dir)
    stages = [
        NullAwareStandardScaler(inputCols=_DENSE),
        VectorAssembler(inputCols=_DENSE, outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="y1", solver="normal"),
    ]
    model = Pipeline(stages=stages).fit(train)
    path = scratch_path(spark, "pipeline_model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return r6(loaded.transform(test).select("ccn", "y1", "prediction"))


def _reloaded(spark, model, name: str):
    """A model saved to the shared folder and read again, as a later job would."""
    path = scratch_path(spark, name)
    model.write().overwrite().save(path)
    return type(model).load(path)


_UNSCALED = ["x4"]


@register(
    "knn_regress_pipeline",
    _scaled_imputed_sql(
        ", f AS (SELECT z.ccn, z.part, z.y1, {unrounded} FROM z CROSS JOIN mu WHERE z.y1 IS NOT NULL), "
        "fa AS (SELECT * FROM f WHERE part = 'train'), fe AS (SELECT * FROM f WHERE part = 'test'), "
        + _knn_pairs_sql(_X, "fe", "fa", [*_X, "y1"]).replace("dg AS", "dg2 AS").replace("JOIN dg d", "JOIN dg2 d").replace("pr AS", "pr2 AS").replace("FROM pr)", "FROM pr2)").replace("pd AS", "pd2 AS")
        + ", rk2 AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY dist, gk, dk) AS rn FROM pd2) "
        f"SELECT fe.ccn, fe.y1, round((SELECT avg(d_y1) FROM rk2 WHERE rk2.qk = fe.ccn AND rn <= {S.KNN_REGRESS_K}), 6) AS prediction FROM fe",
        exclude=_UNSCALED,
    ),
)
def q_knn_regress_pipeline(spark, sf_dir):
    """J10 on all features, scaled but for ``x4`` and imputed by the pipeline that the training rows fitted."""
    sp = split_table(spark, sf_dir).where(F.col("y1").isNotNull()).select("ccn", "part", "y1", *_X)
    model = preprocessing(exclude=_UNSCALED).fit(sp.where("part = 'train'"))
    done = cut_lineage_df(model.transform(sp))
    train, test = done.where("part = 'train'"), done.where("part = 'test'")
    return r6(knn.knn_regress(test, train, "ccn", _X, "y1", k=S.KNN_REGRESS_K).select("ccn", "y1", "prediction"))


def _regression(features, label: str, stage):
    from pyspark.ml.feature import VectorAssembler

    return preprocessing(features, "ccn", VectorAssembler(inputCols=list(features), outputCol="features"), stage)


@register("train_insight")
def q_train_insight(spark, sf_dir):
    """P7: per target, one pipeline of scaler, imputer and OLS fitted on the raw training rows; the whole pipeline
    is saved, and the coefficient table comes from the one read again."""
    from pyspark.ml.regression import LinearRegression

    sp = split_table(spark, sf_dir)
    out = None
    for y in S.TARGETS:
        train = sp.where((F.col("part") == "train") & F.col(y).isNotNull()).select("ccn", *_X, y)
        linear = LinearRegression(featuresCol="features", labelCol=y, solver="normal", standardization=False)
        model = _reloaded(spark, _regression(_X, y, linear).fit(train), f"insight_{y}")
        t = regress.coefficient_table(spark, model.stages[-1], _X).withColumn("target", F.lit(y))
        out = t if out is None else out.unionByName(t)
    return r6(out.select("target", "feature", "coefficient"))


@register("train_prediction")
def q_train_prediction(spark, sf_dir):
    """P8: search boosted-tree parameters (for the first target, reused for both, as the
    reference does), fit one pipeline of scaler, imputer and trees per target on the raw training rows, save it, score
    the raw unlabelled rows with the one read again."""
    search = evaluate.random_search(_stacked_train(spark, sf_dir), _X, "y1")
    settings = json.dumps(asdict(boosting.Settings.of(search.where(F.col("rank") == 1).first().asDict())))
    f = split_table(spark, sf_dir).select("ccn", "part", *_X, *S.TARGETS)
    unlabelled = f.where(F.col("y1").isNull())
    out = unlabelled.select("ccn")
    for y, name in (("y1", "would_recommend"), ("y2", "rating_est")):
        labelled = f.where((F.col("part") == "train") & F.col(y).isNotNull())
        trees = boosting.HistogramBoosting(featureCols=_X, labelCol=y, predictionCol=name, settings=settings)
        model = _reloaded(spark, preprocessing(_X, "ccn", trees).fit(labelled), f"prediction_{y}")
        out = out.join(model.transform(unlabelled).select("ccn", name), "ccn")
    return r6(out)


@register("compare_models")
def q_compare_models(spark, sf_dir):
    """P9: the two comparison reports in one table, all models and both targets (split is null in the first)."""
    cv = _cv_report(spark, sf_dir).withColumns({"report": F.lit("cv"), "split": F.lit(None).cast("int")})
    rs = _resample_report(spark, sf_dir).withColumn("report", F.lit("resample"))
    return r6(cv.unionByName(rs))


from . import feature_models  # noqa: E402,F401  (registers the models on the feature table)
