"""Splits, folds and simulated missingness.

All randomness is ``md5(key|seed)``: reproducible on any partitioning and in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import md5_rank_key, md5_uniform

_BUCKET_HEX = 3  # 4096 hash buckets per stratum


def stratified_split(
    df: DataFrame,
    strata: str = "state",
    key: str = "ccn",
    test_share: float = S.TEST_SHARE,
    seed: int = S.DEFAULT_SEED,
    out: str = "part",
) -> DataFrame:
    """Adds ``part`` = 'test' for the ``ceil(test_share * n)`` rows of each stratum with the
    smallest ``md5(key|seed)``, else 'train'; one-row strata go to train.

    Exact per-stratum sizes without a window over a whole stratum (a hot stratum could hold a
    third of all rows): rows are counted per (stratum, hash bucket) with partial aggregation,
    the boundary bucket of each stratum is found on that small table, and rows are ranked in a
    window partitioned by (stratum, bucket), which the join on the same keys has dealt out already.
    """
    h = md5_rank_key(key, seed)
    d = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, _BUCKET_HEX), 16, 10).cast("int"))
    # NULL is a stratum of its own (a plain join would drop those rows)
    d = d.withColumn("_s", F.coalesce(F.col(strata).cast("string"), F.lit("\u0000")))
    strata = "_s"
    counts = d.groupBy(strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_cum = Window.partitionBy(strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(strata)
    n = F.sum("_cnt").over(w_all)
    k = F.when(n <= 1, F.lit(0)).otherwise(F.ceil(F.lit(test_share) * n))
    plan = counts.select(strata, "_b", "_cnt", F.coalesce(F.sum("_cnt").over(w_cum), F.lit(0)).alias("_before"), k.alias("_k"))
    # per (stratum, bucket): all-test, all-train, or boundary with the number of test rows in it
    plan = plan.select(
        strata,
        "_b",
        F.when(F.col("_before") + F.col("_cnt") <= F.col("_k"), F.lit("test"))
        .when(F.col("_before") >= F.col("_k"), F.lit("train"))
        .otherwise(F.lit("edge"))
        .alias("_kind"),
        (F.col("_k") - F.col("_before")).alias("_need"),
    )
    j = d.join(plan, [strata, "_b"], "left")
    rn = F.row_number().over(Window.partitionBy(strata, "_b").orderBy("_h"))
    edge = F.when(rn <= F.col("_need"), F.lit("test")).otherwise(F.lit("train"))
    # rows without a key have no bucket and are never tested on
    j = j.withColumn(out, F.when(F.col("_kind") == "edge", edge).otherwise(F.coalesce(F.col("_kind"), F.lit("train"))))
    return j.drop("_h", "_b", "_kind", "_need", "_s")


def select_part(df: DataFrame, part: str, label: str | None = None, column: str = "part") -> DataFrame:
    """'train' / 'test' / 'both' rows, then (split first) rows with a NULL label dropped;
    'full' ignores the split."""
    if part in ("train", "test"):
        df = df.where(F.col(column) == part)
    elif part not in ("both", "full"):
        raise ValueError(f"unknown part {part!r}")
    return df.where(F.col(label).isNotNull()) if label else df


def select_xy(df: DataFrame, mask: Column, features: Sequence[str], label: str) -> DataFrame:
    return df.where(mask).select(*features, label)


def fold_column(key: str = "ccn", seed: int = S.DEFAULT_SEED, folds: int = S.N_FOLDS) -> Column:
    """Fold id from md5 (near-equal folds without a global sort)."""
    return F.pmod(F.conv(F.substring(md5_rank_key(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def missing_rates(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """NULL fraction per feature (one aggregate row: bounded by the number of features)."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features]).first()
    return {c: float(row[c] or 0.0) for c in features}


def inject_missing(df: DataFrame, rates: Mapping[str, float], key: str = "ccn", seed: int = S.DEFAULT_SEED, salt: str = "") -> DataFrame:
    """Set a cell to NULL when ``u(key|column|salt, seed) < rate`` (MCAR at the given rates)."""
    new = {}
    for c, rate in rates.items():
        u = md5_uniform(F.concat(F.col(key).cast("string"), F.lit(f"|{c}{salt}")), seed)
        new[c] = F.when(u < F.lit(rate), F.lit(None).cast("double")).otherwise(F.col(c))
    return df.withColumns(new)


def resample_test_flag(key: str, split: int, seed: int = S.DEFAULT_SEED, share: float = S.RESAMPLE_TEST_SHARE) -> Column:
    """Random 80/20 split number ``split``: test when ``u(key|split) < share``."""
    return md5_uniform(F.concat(F.col(key).cast("string"), F.lit(f"|split{split}")), seed) < F.lit(share)
