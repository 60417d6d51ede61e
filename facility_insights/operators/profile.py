"""Profiling and summary aggregates.

All of these are single aggregate passes with map-side partial aggregation; nothing collects
rows. Wide one-row results are unpivoted at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_profile(df: DataFrame, columns: Sequence[str], name: str = "missing_frac") -> DataFrame:
    """(variable, fraction of NULL) for every column, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "variable", name)


def missing_matrix(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Long (variable, target, missing_frac): NULL fraction of ``variable`` among rows where
    ``target`` is present. All |columns| x |targets| cells in one aggregate pass."""
    aggs = []
    names = []
    for t in targets:
        present = F.col(t).isNotNull()
        for c in columns:
            n = f"{t}\u0001{c}"
            names.append(n)
            aggs.append(F.avg(F.when(present, F.col(c).isNull().cast("double"))).alias(n))
    one = df.agg(*aggs)
    long = one.unpivot([], names, "_cell", "missing_frac")
    parts = F.split(F.col("_cell"), "\u0001")
    return long.select(parts[1].alias("variable"), parts[0].alias("target"), "missing_frac")


def missing_matrix_wide(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(variable, <target>...) — the matrix with one column per target."""
    aggs = []
    for t in targets:
        present = F.col(t).isNotNull()
        for c in columns:
            aggs.append(F.avg(F.when(present, F.col(c).isNull().cast("double"))).alias(f"{c}\u0001{t}"))
    one = df.agg(*aggs)
    stack = F.array(
        *[F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}\u0001{t}`").alias(t) for t in targets]) for c in columns]
    )
    return one.select(F.inline(stack))


def missing_summary(df: DataFrame, columns: Sequence[str], targets: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """(variable, TOTAL, <target>...): overall NULL fraction and the conditional fractions of
    every column in one pass: NULL flags are unpivoted next to the target-present flags and
    grouped by variable (map-side partial aggregation leaves one row per variable and task, and
    the generated code stays small however many columns there are)."""
    flags = [F.col(c).isNull().cast("double").alias(c) for c in columns]
    present = [F.col(t).isNotNull().alias(f"_p{i}") for i, t in enumerate(targets)]
    long = df.select(*present, *flags).unpivot([f"_p{i}" for i in range(len(targets))], list(columns), "variable", "_miss")
    return long.groupBy("variable").agg(
        F.avg("_miss").alias(total),
        *[F.avg(F.when(F.col(f"_p{i}"), F.col("_miss"))).alias(t) for i, t in enumerate(targets)],
    )


def benchmark_means(df: DataFrame, columns: Sequence[str], by: str = "state") -> DataFrame:
    """Null-skipping means per group and over everything, in one job (ROLLUP = grouping sets
    ``(by), ()``). ``scope`` is 'national' for the total row."""
    g = df.rollup(by).agg(*[F.avg(c).alias(c) for c in columns], F.grouping(by).alias("_g"))
    scope = F.when(F.col("_g") == 1, F.lit("national")).otherwise(F.lit("state"))
    return g.select(scope.alias("scope"), F.col(by), *columns)


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def entities_in_group(df: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name) sorted, duplicates kept — the per-state entity list for every state at once."""
    return df.select(group, name).where(F.col(group).isNotNull()).orderBy(group, name)


def group_coverage(df: DataFrame, group: str, column: str) -> DataFrame:
    """Per group: number of rows with a value, and the 'not enough values' flag."""
    g = df.groupBy(group).agg(F.count_if(F.col(column).isNotNull()).cast("bigint").alias("n_values"))
    return g.withColumn("enough", (F.col("n_values") > 0).cast("int"))
