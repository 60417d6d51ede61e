"""Hand-made frames for the traps that change answers."""

import math

from pyspark.sql import functions as F

from facility_insights.functions import canonical_key, clean_numeric_text, days_since, parse_signed_coord
from facility_insights.operators import clean, features, merge, reshape


def test_t1_nan_text_is_null_not_nan(spark):
    df = spark.createDataFrame([("nan",), ("NA",), ("**",), ("***",), ("NANA",), (" $1,234.50 ",), ("45%",), ("*",), ("",)], "x string")
    got = [r[0] for r in df.select(clean_numeric_text("x")).collect()]
    assert got == [None, None, None, None, None, 1234.5, 45.0, None, None]


def test_t2_not_in_keeps_null(spark):
    df = spark.createDataFrame([("PR",), (None,), ("CA",)], "state string")
    got = sorted((r[0] or "") for r in clean.filter_not_in_keep_null(df, "state", ["PR"]).collect())
    assert got == ["", "CA"]


def test_t4_divide_by_zero_is_null(spark):
    df = spark.createDataFrame([(10.0, 0.0, 5.0, 0.0)], "distinct_bens double, total_charge double, nurse_visit_ct double, z double")
    df = df.withColumn("distinct_bens", F.lit(0.0))
    r = features.per_beneficiary(df).first()
    assert r["total_charge_pb"] is None and r["nurse_visit_ct_pb"] is None


def test_t5_t6_collapse_is_min_and_null_struct_loses(spark):
    df = spark.createDataFrame(
        [("1", "b", None, 2.0), ("1", "a", 5.0, None), ("2", "z", None, None)],
        "ccn string, name string, lat double, v double",
    ).withColumn("ll", F.struct("lat", F.col("lat").alias("lng")))
    out = {r["ccn"]: r for r in merge.collapse_duplicates(df, "ccn").collect()}
    assert out["1"]["name"] == "a" and out["1"]["v"] == 2.0 and out["1"]["ll"]["lat"] == 5.0
    assert out["2"]["ll"] is None


def test_t9_last_duplicate_wins_t10_case(spark):
    cities = spark.createDataFrame([(1, "Springfield", "IL", 1.0, 2.0), (2, "SPRINGFIELD", "IL", 3.0, 4.0)], "ord int, city string, state_id string, lat double, lng double")
    counties = spark.createDataFrame([(1, "Cook", "IL", "+41.5°", "–87.5°")], "ord int, county string, state string, latitude string, longitude string")
    df = spark.createDataFrame([("a", "springfield", "IL", "x"), ("b", "Nowhere", "IL", "Cook"), ("c", "Nowhere", "IL", "cook")], "ccn string, city string, state string, county string")
    out = {r["ccn"]: r["lat_long"] for r in merge.geo_lookup_cascade(df, cities, counties).collect()}
    assert (out["a"]["lat"], out["a"]["lng"]) == (3.0, 4.0)
    assert (out["b"]["lat"], out["b"]["lng"]) == (41.5, -87.5)
    assert out["c"] is None


def test_t11_strictly_above_threshold(spark):
    cols = ["perc_white", "perc_black", "perc_asian", "perc_hisp", "perc_native", "perc_other"]
    df = spark.createDataFrame([(95.0, None, None, None, None, None), (95.5, None, None, None, None, None)], ", ".join(f"{c} double" for c in cols))
    rows = features.impute_demographics(df).collect()
    assert rows[0]["perc_black"] is None and rows[1]["perc_black"] == 0.0
    assert rows[1]["perc_nonwhite"] == 4.5


def test_t21_dummies_null_all_zero(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None), ("3", "b")], "ccn string, c string")
    out = {r["ccn"]: (r["c_a"], r["c_b"]) for r in reshape.one_hot(df, ["c"]).collect()}
    assert out == {"1": (1, 0), "2": (0, 0), "3": (0, 1)}


def test_t22_days_may_be_negative_and_keys(spark):
    df = spark.createDataFrame([("06/01/2018", "0123"), ("01/01/1998", "0012.0")], "d string, k string")
    r = df.select(days_since("d").alias("n"), canonical_key("k").alias("a"), canonical_key("k", via_float=True).alias("b")).collect()
    assert r[0]["n"] == -516 and r[1]["n"] == 6940
    assert r[0]["a"] == "123" and r[1]["b"] == "12"


def test_signed_coordinates(spark):
    df = spark.createDataFrame([("+32.5°",), ("–86.25°",), ("-1.0°",)], "c string")
    assert [r[0] for r in df.select(parse_signed_coord("c")).collect()] == [32.5, -86.25, -1.0]


def test_t25_population_std_and_zero_variance(spark):
    from facility_insights.models.scaler import NullAwareStandardScaler

    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    m = NullAwareStandardScaler(inputCols=["a", "b"]).fit(df)
    p = m.params_of()
    assert p["a"] == (2.0, 1.0) and p["b"] == (5.0, 1.0)
    out = m.transform(df).collect()
    assert out[0]["a"] == -1.0 and out[2]["a"] is None and out[0]["b"] == 0.0


def test_pivot_repeated_cell_raises(spark):
    import pytest

    df = spark.createDataFrame([("1", "A", "x"), ("1", "A", "y")], "ccn string, code string, score string")
    with pytest.raises(reshape.DuplicatePivotCell):
        reshape.pivot_measures(df, levels=["A"], check_unique=True)


def test_rating_and_reverse_minmax_constant(spark):
    df = spark.createDataFrame([(10.0, 20.0, 70.0, 1.0), (0.0, 0.0, 100.0, 1.0)], "RATING_BBV double, RATING_MBV double, RATING_TBV double, k double")
    r = features.rating_estimate(df).collect()
    assert math.isclose(r[0]["RATING_EST"], 0.01 * 3.5 * 10 + 0.01 * 7.5 * 20 + 0.01 * 9.5 * 70)
    mm = features.reverse_minmax(df, ["k", "RATING_BBV"]).collect()
    assert [x["k"] for x in mm] == [1.0, 1.0] and [x["RATING_BBV"] for x in mm] == [0.0, 1.0]
