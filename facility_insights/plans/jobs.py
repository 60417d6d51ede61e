"""Composite jobs: source clean-ups, the merge, the feature table.

Each job is a pure function of input DataFrames; nothing runs until an action. The merge is one
lineage: four source clean-ups, a left-join chain, one hash aggregate that removes exact and
conflicting duplicates, and a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import canonical_key, days_since
from ..operators import clean, features, geo, merge, reshape
from ..session import cut_lineage


def _numeric_scores(long: DataFrame, tokens) -> DataFrame:
    """(ccn, code, score) with missing tokens -> NULL and numeric scores, so that the pivot is a hash aggregate."""
    return clean.cast_columns(clean.sentinels_to_null(long.select("ccn", "code", "score"), tokens, columns=["score"]), ["score"], "double")


def clean_survey(survey_long: DataFrame, codes=S.SURVEY_CODES) -> DataFrame:
    """Long survey: tokens -> NULL, numeric, -> wide (one column per code), canonical key."""
    wide = reshape.pivot_measures(_numeric_scores(survey_long, S.SURVEY_MISSING_TOKENS), "ccn", "code", "score", levels=codes)
    return wide.withColumn("ccn", canonical_key("ccn"))


def clean_provider(provider_long: DataFrame, cities: DataFrame, counties: DataFrame, floats=S.PROVIDER_FLOATS) -> DataFrame:
    """Code filter, tokens and casts, pivot, identity join, territory filter, coordinates, tokens of the identity, key."""
    kept = clean.filter_not_contains(provider_long, "code", S.DROPPED_CODE_MARK)
    measures = reshape.pivot_measures(_numeric_scores(kept, S.PROVIDER_MISSING_TOKENS), "ccn", "code", "score", levels=floats)
    ids = kept.select(*S.PROVIDER_ID_COLUMNS)
    wide = merge.join_identity_measures(ids, measures, "ccn")
    wide = clean.filter_not_in_keep_null(wide, "state", S.EXCLUDED_STATES)
    wide = merge.geo_lookup_cascade(wide, cities, counties)
    wide = clean.sentinels_to_null(wide, S.PROVIDER_MISSING_TOKENS)
    return wide.withColumn("ccn", canonical_key("ccn"))


def clean_facility(facility: DataFrame) -> DataFrame:
    """(ccn, ownership, care_home, days_operation) with the canonical key."""
    return facility.select(
        canonical_key("ccn").alias("ccn"),
        "ownership",
        "care_home",
        days_since("cert_date").alias("days_operation"),
    )


def clean_usage(usage_raw: DataFrame, measures=S.USAGE_MEASURES) -> DataFrame:
    """Provider x hospice rows, text -> numbers, key via float, all-empty columns dropped."""
    rows = usage_raw.where(
        (F.col("summary_category") == S.USAGE_SUMMARY_CATEGORY) & (F.col("service_category") == S.USAGE_SERVICE_CATEGORY)
    ).drop("summary_category", "service_category")
    rows = clean.clean_numeric_columns(rows, measures)
    rows = rows.withColumnRenamed("provider_id", "ccn").withColumn("ccn", canonical_key("ccn", via_float=True))
    return rows


def drop_empty_usage_columns(usage: DataFrame) -> DataFrame:
    """The data-dependent step of the usage clean-up (one count pass)."""
    return clean.drop_all_null_columns(usage, keep=["ccn"])


def merge_all(facility: DataFrame, provider: DataFrame, usage: DataFrame, demographics: DataFrame, survey: DataFrame) -> DataFrame:
    """facility ⟕ provider ⟕ usage ⟕ demographics ⟕ survey on ccn, duplicates collapsed, rows
    without a state removed."""
    joined = merge.merge_sources(facility, provider, usage, demographics, survey, key="ccn")
    collapsed = merge.collapse_duplicates(joined, "ccn")
    return collapsed.where(F.col("state").isNotNull())


def merged_from_shapes(spark, sf_dir: str, drop_empty: bool = False) -> DataFrame:
    from ..sources import shapes as sh

    usage = clean_usage(sh.usage_raw(spark, sf_dir))
    usage = drop_empty_usage_columns(usage) if drop_empty else usage.drop("all_missing")
    return merge_all(
        clean_facility(sh.facility(spark, sf_dir)),
        clean_provider(sh.provider_long(spark, sf_dir), sh.city_lookup(spark, sf_dir), sh.county_lookup(spark, sf_dir)),
        usage,
        sh.shares(spark, sf_dir),
        clean_survey(sh.survey_long(spark, sf_dir)),
    )


FEATURE_STEPS = [
    "distance",
    "per_beneficiary",
    "missing_level",
    "demographics",
    "adjusted",
    "rating",
    "ratios",
    "managed",
    "for_profit",
    "recommend",
    "dummies",
]


def all_features(merged: DataFrame, steps=FEATURE_STEPS, dummy_levels=None, checkpoint: bool = True) -> DataFrame:
    """The fixed-order feature chain over the merged table.

    The merged table is read several times (places for the radius join, the join back, the
    min-max fit), so it is checkpointed once into the shared folder first.
    """
    if checkpoint:
        merged = cut_lineage(merged)
    table = {
        "distance": lambda d: geo.add_distance_features(d, "lat_long"),
        "per_beneficiary": features.per_beneficiary,
        "missing_level": reshape.missing_level,
        "demographics": features.impute_demographics,
        "adjusted": features.quality_adjusted,
        "rating": features.rating_estimate,
        "ratios": features.quality_ratios,
        "managed": features.managed_scores,
        "for_profit": features.for_profit_flag,
        "recommend": features.would_recommend,
        "dummies": lambda d: reshape.one_hot(d, S.DUMMY_SOURCE_COLUMNS, dummy_levels),
    }
    return features.chain(merged, [table[s] for s in steps])
