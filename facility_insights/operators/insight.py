"""Per-entity insight operators, for every entity at once.

Windows are partitioned by the entity (a handful of rows each), never over a whole table;
national standings come from value counts instead of a one-partition window over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def driver_top_bottom(long: DataFrame, entity: str, item: str, score: str, n_worst: int = 3) -> DataFrame:
    """Per entity: best item, worst item, the ``n_worst`` lowest items (worst first) and the sum
    of their scores, with 'raised'/'lowered' for the sign of that sum.

    Order is score descending, ties by item name (F1); one window per entity.
    """
    l = long.where(F.col(score).isNotNull())
    desc = Window.partitionBy(entity).orderBy(F.col(score).desc(), F.col(item))
    asc = Window.partitionBy(entity).orderBy(F.col(score).asc(), F.col(item).desc())
    r = l.withColumn("_rd", F.row_number().over(desc)).withColumn("_ra", F.row_number().over(asc))
    worst = F.when(F.col("_ra") <= n_worst, F.struct(F.col("_ra").alias("r"), F.col(item).alias("i")))
    g = r.groupBy(entity).agg(
        F.max(F.when(F.col("_rd") == 1, F.col(item))).alias("best"),
        F.max(F.when(F.col("_rd") == 1, F.col(score))).alias("best_score"),
        F.max(F.when(F.col("_ra") == 1, F.col(item))).alias("worst"),
        F.max(F.when(F.col("_ra") == 1, F.col(score))).alias("worst_score"),
        F.sort_array(F.collect_list(worst)).alias("_w"),
        F.sum(F.when(F.col("_ra") <= n_worst, F.col(score))).alias("worst_sum"),
    )
    return g.select(
        entity,
        "best",
        "best_score",
        "worst",
        "worst_score",
        F.array_join(F.transform("_w", lambda s: s["i"]), "|").alias("worst_items"),
        "worst_sum",
        F.when(F.col("worst_sum") > 0, F.lit("raised")).otherwise(F.lit("lowered")).alias("direction"),
    )


def _running_counts(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by ..., value, _lt, _le, _n): rows below, rows up to and rows in all, from counts _c of distinct values.

    Values are dealt out by range; each range is summed up by itself and begins at the sum of the
    ranges before it. Only the ranges' sums, one row for each range (and group), are summed in one place.
    """
    dealt = cut_lineage(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    before = (F.sum("_s").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_s")).alias("_before")
    starts = sums.select(*by, "_range", before, F.sum("_s").over(Window.partitionBy(*by)).alias("_n"))
    summed = dealt.withColumn("_up", F.sum("_c").over(inside)).join(starts, [*by, "_range"])
    up = F.col("_before") + F.col("_up")
    return summed.select(*by, value, (up - F.col("_c")).alias("_lt"), up.alias("_le"), "_n")


def entity_standing(df: DataFrame, entity: str, group: str, value: str) -> DataFrame:
    """Per entity: share of rows with a lower value (percent_rank) and with a value <= its own
    (cume_dist), within its group and over all rows.

    Built from value counts per (group, value) and per value, summed up over ranges of values, so
    no task ever holds all values of a large group or of the table, even if no two rows share one.
    The rows meet their standing in one join, whose common values AQE splits.
    """
    v = df.where(F.col(value).isNotNull())
    counts = cut_lineage(v.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c")))
    gv = _running_counts(counts, value, [group]).toDF(group, value, "_lt_g", "_le_g", "_n_g")
    nv = _running_counts(counts.groupBy(value).agg(F.sum("_c").alias("_c")), value, [])
    out = v.select(entity, group, value).join(gv.join(nv, value), [group, value])

    def pr(lt, n):
        return F.when(F.col(n) > 1, F.col(lt) / (F.col(n) - 1)).otherwise(F.lit(0.0))

    return out.select(
        entity,
        group,
        value,
        pr("_lt_g", "_n_g").alias("group_percent_rank"),
        (F.col("_le_g") / F.col("_n_g")).alias("group_cume_dist"),
        pr("_lt", "_n").alias("nation_percent_rank"),
        (F.col("_le") / F.col("_n")).alias("nation_cume_dist"),
    )


def coefficient_table(spark: SparkSession, coefficients: Mapping[str, float], labels: Mapping[str, str]) -> DataFrame:
    """(feature, label, coefficient); labels are a dimension with a unique key (checked)."""
    if len(set(labels)) != len(labels):
        raise ValueError("duplicate feature in labels")
    rows = [(f, labels.get(f, f), float(c)) for f, c in coefficients.items() if f != "intercept"]
    return spark.createDataFrame(rows, "feature string, label string, coefficient double")


def contributions(scaled: DataFrame, raw: Mapping[str, str], key: str, coefs: DataFrame, means: DataFrame) -> DataFrame:
    """Per entity x feature: your score (raw value), mean score, coefficient, z, contribution = β·z.

    ``scaled`` holds each transformed feature under its name and its un-scaled value under the name
    that ``raw`` gives, so a row brings both; ``coefs`` is (feature, label, coefficient) and
    ``means`` (feature, mean_score) — parameter tables with one row per feature, joined as broadcasts.
    """
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("z"), F.col(r).cast("double").alias("your_score")) for f, r in raw.items()]
    out = scaled.select(key, F.inline(F.array(*cells))).join(F.broadcast(coefs), "feature").join(F.broadcast(means), "feature")
    return out.withColumn("contribution", F.col("coefficient") * F.col("z"))


def column_means(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_score) over all rows, NULLs skipped (one aggregate, unpivoted)."""
    one = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "mean_score")


def recommendations(contrib: DataFrame, key: str, actionable: Sequence[str], predicted: DataFrame, n_worst: int = 3) -> DataFrame:
    """Targeted recommendation per entity over the actionable features (F1 + F2), with the
    predicted and actual scores rounded half-to-even to 2 decimals."""
    c = contrib.where(F.col("feature").isin(list(actionable)))
    tb = driver_top_bottom(c, key, "label", "contribution", n_worst)
    p = predicted.select(key, F.bround("predicted", 2).alias("predicted"), F.bround("actual", 2).alias("actual"))
    return tb.join(p, key, "left")
