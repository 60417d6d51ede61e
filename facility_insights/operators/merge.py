"""Joins, lookups, duplicate handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import parse_signed_coord, text_key


def join_identity_measures(ids: DataFrame, measures: DataFrame, key: str = "ccn") -> DataFrame:
    """Distinct identity rows x wide measures (inner equi-join)."""
    return ids.dropDuplicates().join(measures, key)


def merge_sources(base: DataFrame, *others: DataFrame, key: str = "ccn") -> DataFrame:
    """Left-outer star chain ``base ⟕ others[0] ⟕ others[1] ...`` on the key.

    No hints: AQE turns a join into a broadcast hash join at run time when the measured side is
    small, and keeps a sort-merge join (with skew splitting) otherwise.
    """
    out = base
    for o in others:
        out = out.join(o, key, "left")
    return out


def latest_by_key(lookup: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the largest ``order`` (last row wins)."""
    packed = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(order))
    return lookup.groupBy(key).agg(packed.alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def city_coordinates(cities: DataFrame, city="city", state="state_id", lat="lat", lng="lng", order="ord") -> DataFrame:
    """City lookup keyed by lower('city state'); duplicates: last row wins."""
    keyed = cities.select(text_key(city, state, lower=True).alias("_key"), F.col(order), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    return latest_by_key(keyed.where(F.col("_key").isNotNull()), "_key", order, ["lat", "lng"])


def county_coordinates(counties: DataFrame, county="county", state="state", lat="latitude", lng="longitude", order="ord") -> DataFrame:
    """County lookup keyed by 'county state' (case-sensitive); signed text coordinates parsed."""
    keyed = counties.select(
        text_key(county, state).alias("_key"), F.col(order), parse_signed_coord(lat).alias("lat"), parse_signed_coord(lng).alias("lng")
    )
    return latest_by_key(keyed.where(F.col("_key").isNotNull()), "_key", order, ["lat", "lng"])


def geo_lookup_cascade(
    df: DataFrame,
    cities: DataFrame,
    counties: DataFrame,
    city: str = "city",
    state: str = "state",
    county: str = "county",
    out: str = "lat_long",
) -> DataFrame:
    """Coordinates from the city lookup, else the county lookup, else NULL, as a struct column.

    Both lookups are deduplicated to one row per key first (an aggregate whose size is bounded by
    the number of distinct places), then left-joined; AQE broadcasts them when small.
    """
    cc = city_coordinates(cities).select(F.col("_key").alias("_ck"), F.struct("lat", "lng").alias("_cll"))
    kc = county_coordinates(counties).select(F.col("_key").alias("_kk"), F.struct("lat", "lng").alias("_kll"))
    j = (
        df.withColumn("_ck", text_key(city, state, lower=True))
        .withColumn("_kk", text_key(county, state))
        .join(cc, "_ck", "left")
        .join(kc, "_kk", "left")
    )
    return j.withColumn(out, F.coalesce("_cll", "_kll")).drop("_ck", "_kk", "_cll", "_kll")


def collapse_duplicates(df: DataFrame, key: str = "ccn") -> DataFrame:
    """Exact duplicates removed and conflicting rows of one key collapsed, in one aggregate.

    Per key and column the least non-NULL value (``min`` skips NULLs; identity on singletons, so
    distinct + split + collapse + union collapse into a single hash aggregate with map-side
    partial aggregation). A struct whose fields are all NULL is turned into NULL first, so it
    does not win the ``min``.
    """
    prepared = []
    for f in df.schema.fields:
        if f.name == key:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, StructType):
            all_null = None
            for sub in f.dataType.fieldNames():
                t = c[sub].isNull()
                all_null = t if all_null is None else (all_null & t)
            c = F.when(all_null, F.lit(None)).otherwise(c)
        prepared.append(F.min(c).alias(f.name))
    return df.groupBy(key).agg(*prepared).select(df.columns)


def duplicated_keys(df: DataFrame, key: str = "ccn", repeated: bool = True) -> DataFrame:
    """Rows whose key occurs more than once (``repeated``) or exactly once."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    cond = F.col("_n") > 1 if repeated else F.col("_n") == 1
    return df.join(counts.where(cond), key, "left_semi")


def variable_catalog(spark: SparkSession, sources: Sequence[tuple[str, Sequence[str]]], descriptions: Sequence[tuple[str, Mapping[str, str]]], columns: Sequence[str]) -> DataFrame:
    """(variable, source, description) for the given merged columns.

    ``sources`` lists (source name, its columns) in priority order; ``descriptions`` lists
    (dictionary name, {variable: text}) in priority order. Built from schema metadata only
    (column names), so its size is bounded by the number of columns; joined by ``min_by``.
    """
    src_rows = [(v, name, i) for i, (name, cols) in enumerate(sources) for v in cols]
    desc_rows = [(v, text, i) for i, (_, d) in enumerate(descriptions) for v, text in d.items()]
    src = spark.createDataFrame(src_rows, "variable string, source string, priority int")
    desc = spark.createDataFrame(desc_rows or [("", "", 0)], "variable string, description string, priority int")
    var = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "variable string, position int")
    s = src.groupBy("variable").agg(F.min_by("source", "priority").alias("source"))
    d = desc.groupBy("variable").agg(F.min_by("description", "priority").alias("description"))
    out = var.join(s, "variable", "left").join(d, "variable", "left")
    last = sources[-1][0] if sources else None
    return out.select(
        "variable",
        "position",
        F.coalesce("source", F.lit(last)).alias("source"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def resolve_scores(observed: DataFrame, predicted: DataFrame, columns: Sequence[str], key: str = "ccn") -> DataFrame:
    """Predicted value when the key has a prediction, else the observed one, plus ``is_predicted``."""
    p = predicted.select(key, F.lit(1).alias("_p"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = observed.select(key, *columns).join(p, key, "left")
    is_p = F.col("_p").isNotNull()
    return j.select(
        key,
        *[F.when(is_p, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        is_p.cast("int").alias("is_predicted"),
    )
