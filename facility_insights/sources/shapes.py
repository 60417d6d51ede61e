"""Shape views: the reference's input shapes, derived from the driver's tables with DataFrame code.

The reference reads public CSV files that are not available; these views rebuild their shapes
(long survey table, provider identity + measures, lookups, usage file, ...) from the TPC-H-like
tables so that every operator runs on data whose size grows with the scale factor. The same views
exist as SQL in ``plans/oracle_shapes.py`` for the DuckDB check. ``k`` is ``c_custkey`` and the entity key
is ``ccn = 100000 + k`` as text, every tenth key with one leading zero; modulus rules place the
dirty values (tokens, nulls, duplicates) that the reference cleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ccn(k: Column, leading_zero: bool = True) -> Column:
    base = (F.lit(100000) + k).cast("string")
    if not leading_zero:
        return base
    return F.concat(F.when(k % 10 == 0, F.lit("0")).otherwise(F.lit("")), base)


def survey_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, code, score): three answer-bin rows per (customer, order-priority stem)."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("nm"),
    )
    stem = (
        F.when(F.col("p") == "1", "RECOMMEND")
        .when(F.col("p") == "2", "RATING")
        .when(F.col("p") == "3", "SYMPTOMS")
        .when(F.col("p") == "4", "TRAINING")
        .otherwise("EMO_REL")
    )
    b = F.floor((F.col("nb") * 100).cast("double") / F.col("n")).cast("int")
    m = F.floor((F.col("nm") * 100).cast("double") / F.col("n")).cast("int")
    s = g.select("k", stem.alias("stem"), b.alias("b"), m.alias("m"))
    bins = F.array(
        F.struct(F.concat(F.col("stem"), F.lit("_BBV")).alias("code"), F.col("b").alias("v")),
        F.struct(F.concat(F.col("stem"), F.lit("_MBV")).alias("code"), F.col("m").alias("v")),
        F.struct(F.concat(F.col("stem"), F.lit("_TBV")).alias("code"), (100 - F.col("b") - F.col("m")).alias("v")),
    )
    u = s.select("k", F.inline(bins))
    k = F.col("k")
    score = (
        F.when(k % 7 == 0, "Not Available")
        .when(k % 11 == 0, "Not  Available")
        .when(k % 13 == 0, "Not Applicable")
        .otherwise(F.col("v").cast("string"))
    )
    return u.select(_ccn(k).alias("ccn"), "code", score.alias("score"))


def facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, ownership, care_home, cert_date)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    ownership = (
        F.when(k % 37 == 0, F.lit(None).cast("string"))
        .when(seg == "BUILDING", "For-Profit")
        .when(seg == "MACHINERY", "Non-Profit")
        .when(seg == "HOUSEHOLD", "Government")
        .when(seg == "FURNITURE", "Other")
        .otherwise("Combination Government & Non-Profit")
    )
    care = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise(F.lit(None).cast("string"))
    cert = F.concat(
        F.lpad((1 + k % 12).cast("string"), 2, "0"),
        F.lit("/"),
        F.lpad((1 + k % 28).cast("string"), 2, "0"),
        F.lit("/"),
        (1990 + k % 29).cast("string"),
    )
    return c.select(_ccn(k).alias("ccn"), ownership.alias("ownership"), care.alias("care_home"), cert.alias("cert_date"))


def _customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "n_name"
    )


def provider_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, name, state, city, county): every 29th key a second time, in conflict."""
    b = _customer_nation(spark, sf_dir)
    k = F.col("k")
    first = b.select(
        _ccn(k).alias("ccn"),
        "name",
        F.when(k % 53 == 0, F.lit(None).cast("string")).when(k % 41 == 0, "PR").otherwise(F.col("n_name")).alias("state"),
        F.concat(F.lit("City"), (k % 97).cast("string")).alias("city"),
        F.concat(F.lit("County"), (k % 31).cast("string")).alias("county"),
    )
    second = b.where(k % 29 == 0).select(
        _ccn(k).alias("ccn"),
        F.concat(F.lit("A "), F.col("name")).alias("name"),
        F.col("n_name").alias("state"),
        F.lit(None).cast("string").alias("city"),
        F.concat(F.lit("County"), (k % 31).cast("string")).alias("county"),
    )
    return first.unionByName(second)


def provider_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long provider table: identity columns + (code, score), one row per identity row and code.

    Measures come from each customer's orders; duplicate identity rows (every 29th key) carry
    only the DENOMINATOR code, so a pivot on the filtered codes stays unique per key.
    """
    ids = provider_ids(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("t"),
    )
    per = per.select(_ccn(F.col("k")).alias("ccn"), "k", "n", "t")
    j = ids.join(per, "ccn")
    k = F.col("k")
    dup = F.col("name").startswith("A ")
    codes = F.array(
        F.struct(F.lit("Average_Daily_Census").alias("code"), (F.col("n") * 3).cast("string").alias("v")),
        F.struct(F.lit("H_001_01_OBSERVED").alias("code"), (F.col("t") % 1000).cast("string").alias("v")),
        F.struct(F.lit("H_001_01_DENOMINATOR").alias("code"), (F.col("n") + 11).cast("string").alias("v")),
        F.struct(F.lit("H_002_01_OBSERVED").alias("code"), ((k * 37) % 100).cast("string").alias("v")),
        F.struct(F.lit("Pct_Pts_w_Cancer").alias("code"), ((k * 13) % 60).cast("string").alias("v")),
    )
    rows = j.select(
        "ccn",
        "name",
        F.concat((k % 900 + 100).cast("string"), F.lit(" Main St")).alias("address"),
        "city",
        "state",
        F.lpad((k % 99999).cast("string"), 5, "0").alias("zip"),
        "county",
        "k",
        dup.alias("dup"),
        F.inline(codes),
    )
    rows = rows.where(~F.col("dup") | (F.col("code") == "H_001_01_DENOMINATOR"))
    score = (
        F.when((k % 19 == 0) & (F.col("code") == "Average_Daily_Census"), "Not Available")
        .when((k % 23 == 0) & (F.col("code") == "H_001_01_OBSERVED"), "*")
        .when((k % 17 == 0) & (F.col("code") == "Pct_Pts_w_Cancer"), "Less than 11")
        .otherwise(F.col("v"))
    )
    return rows.select(
        "ccn", "name", "address", "city", "state", "zip", "county", "code", score.alias("score")
    )


def city_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, city, state_id, lat, lng): duplicate keys, upper-case city names."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("p_partkey")
    return p.join(n, (k % 25) == F.col("n_nationkey")).select(
        k.alias("ord"),
        F.concat(F.lit("CITY"), (k % 49).cast("string")).alias("city"),
        F.col("n_name").alias("state_id"),
        (F.lit(25) + ((k * 7919) % 2400).cast("double") / 100).alias("lat"),
        (F.lit(-120) + ((k * 104729) % 5000).cast("double") / 100).alias("lng"),
    )


def county_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, county, state, latitude, longitude): signed text with a unit mark."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("p_partkey")
    return p.join(n, (k % 25) == F.col("n_nationkey")).select(
        k.alias("ord"),
        F.concat(F.lit("County"), (k % 29).cast("string")).alias("county"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("+"), (25 + k % 24).cast("string"), F.lit(".5°")).alias("latitude"),
        F.concat(F.lit("–"), (70 + k % 50).cast("string"), F.lit(".25°")).alias("longitude"),
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, lat, lng): pairs of keys share a place, every 17th key has none."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    even = k - k % 2
    none = k % 17 == 0
    return c.select(
        _ccn(k, leading_zero=False).alias("ccn"),
        F.when(none, F.lit(None).cast("double")).otherwise(F.lit(25) + ((even * 7919) % 2400).cast("double") / 100).alias("lat"),
        F.when(none, F.lit(None).cast("double")).otherwise(F.lit(-120) + ((even * 104729) % 5000).cast("double") / 100).alias("lng"),
    )


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide usage file with dirty text measures; one row per ordering customer."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    a = j.groupBy("o_custkey").agg(
        F.count_distinct("l_orderkey").alias("nd"),
        F.sum(F.floor("l_extendedprice").cast("bigint")).alias("charge"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int")).otherwise(0)).alias("qa"),
    )
    k = F.col("o_custkey")
    return a.select(
        F.when(k % 19 == 0, "STATE").otherwise("PROVIDER").alias("summary_category"),
        F.when(k % 23 == 0, "SNF").otherwise("HOS").alias("service_category"),
        (F.lit(100000) + k).cast("string").alias("provider_id"),
        F.when(k % 31 == 0, "*").otherwise(F.col("nd").cast("string")).alias("distinct_bens"),
        F.when(k % 9 == 0, " NA ")
        .when(k % 8 == 0, "**")
        .otherwise(F.concat(F.lit(" $"), F.col("charge").cast("string"), F.lit(".50 ")))
        .alias("total_charge"),
        F.concat(F.lit("1,"), F.lpad((F.col("qa") % 1000).cast("string"), 3, "0")).alias("nurse_visit_ct"),
        F.concat((k % 101).cast("string"), F.lit("%")).alias("perc_rural"),
        F.lit("*").alias("all_missing"),
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, six demographic percentages with suppressed cells)."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    nul = F.lit(None).cast("double")
    return c.select(
        _ccn(k, leading_zero=False).alias("ccn"),
        (60 + k % 37).cast("double").alias("perc_white"),
        F.when(k % 2 == 0, nul).otherwise((k % 20).cast("double")).alias("perc_black"),
        F.when(k % 3 == 0, nul).otherwise((k % 5).cast("double")).alias("perc_asian"),
        F.when(k % 5 == 0, nul).otherwise((k % 7).cast("double")).alias("perc_hisp"),
        F.when(k % 4 == 0, nul).otherwise(F.lit(0.0)).alias("perc_native"),
        F.when(k % 6 == 0, nul).otherwise(F.lit(1.0)).alias("perc_other"),
    )


def features_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, state, y1, y2, x1..x4): labels missing for every fourth key, x3 and x4 sparse."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    per = o.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"), F.sum(F.floor("o_totalprice").cast("bigint")).alias("t")
    )
    a = c.join(per, c.c_custkey == per.o_custkey, "left").select(
        F.col("c_custkey").alias("k"),
        "c_nationkey",
        "c_acctbal",
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.coalesce(F.col("t"), F.lit(0)).alias("t"),
    )
    k, n = F.col("k"), F.col("n")
    nul = F.lit(None).cast("double")
    return a.select(
        _ccn(k, leading_zero=False).alias("ccn"),
        F.col("c_nationkey").alias("state"),
        F.when(k % 4 == 0, nul).otherwise((60 + n + (k * 31) % 23).cast("double")).alias("y1"),
        F.when(k % 4 == 0, nul).otherwise(5 + ((n * 7 + k * 13) % 50).cast("double") / 10).alias("y2"),
        n.cast("double").alias("x1"),
        F.col("c_acctbal").alias("x2"),
        F.when(k % 5 == 0, nul).otherwise(F.col("t").cast("double") / 1000).alias("x3"),
        F.when(k % 6 == 0, nul).otherwise(((k * 17) % 29).cast("double")).alias("x4"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ccn, would_recommend, rating_est) for the entities a prediction model scored."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.where(k % 4 == 0).select(
        _ccn(k, leading_zero=False).alias("ccn"),
        (70 + k % 25).cast("double").alias("would_recommend"),
        ((60 + k % 40).cast("double") / 10).alias("rating_est"),
    )


SHAPES = {
    "survey_long": survey_long,
    "facility": facility,
    "provider_ids": provider_ids,
    "provider_long": provider_long,
    "city_lookup": city_lookup,
    "county_lookup": county_lookup,
    "geo_points": geo_points,
    "usage_raw": usage_raw,
    "shares": shares,
    "features_num": features_num,
    "predictions": predictions,
}
