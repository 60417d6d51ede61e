"""Reshape operators: pivot, unpivot, one-hot, missing level, column bind."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import schema as S


class DuplicatePivotCell(ValueError):
    """A (key, code) pair occurs more than once in the long table."""


def pivot_measures(
    df: DataFrame,
    key: str = "ccn",
    code: str = "code",
    value: str = "score",
    levels: Sequence[str] | None = None,
    check_unique: bool = False,
) -> DataFrame:
    """Long -> wide: one row per key, one column per code level.

    Pass ``levels`` so Spark skips the distinct-levels job and the plan is stable. A repeated
    (key, code) raises inside the aggregate when the table is computed (the long table must be a
    function of (key, code)). With ``check_unique`` it raises ``DuplicatePivotCell`` at once, by
    one partial-aggregated count. Cast values that end as numbers before: text makes Spark sort the
    long rows for the aggregate, numbers are kept in a hash map.
    """
    if check_unique:
        dup = df.groupBy(key, code).count().where(F.col("count") > 1).limit(1).collect()
        if dup:
            r = dup[0]
            raise DuplicatePivotCell(f"repeated cell {key}={r[key]!r}, {code}={r[code]!r}")
    g = df.groupBy(key)
    p = g.pivot(code, list(levels)) if levels is not None else g.pivot(code)
    repeated = F.raise_error(F.lit(f"repeated cell: a {key} has a {code} more than once")).cast(df.schema[value].dataType)
    return p.agg(F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first(value)))


def unpivot_numeric(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value"
) -> DataFrame:
    """Wide -> long over numeric columns (cast to double)."""
    if values is None:
        values = [f.name for f in df.schema.fields if f.name not in ids and isinstance(f.dataType, NumericType)]
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(ids), list(values), variable, value)


def discover_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct non-null levels of each column, sorted. A first pass counts them in constant memory
    and raises beyond ``MAX_LEVELS``, so what the second one gathers is bounded."""
    counts = df.agg(*[F.approx_count_distinct(F.col(c).cast("string"), 0.02).alias(c) for c in columns]).first()
    wide = {c: counts[c] for c in columns if counts[c] > S.MAX_LEVELS}
    if wide:
        raise ValueError(f"too many levels to make columns of: about {wide}")
    row = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns]).first()
    return {c: list(row[c]) for c in columns}


def one_hot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Dummy columns ``<col>_<level>`` (int 0/1), source column dropped; NULL -> all zeros."""
    columns = list(columns)
    if levels is None:
        levels = discover_levels(df, columns)
    new = {}
    for c in columns:
        for v in levels[c]:
            new[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(new).drop(*columns)


def missing_level(df: DataFrame, columns: Iterable[str] = S.CARE_SETTING_COLUMNS, level: str = S.MISSING_LEVEL) -> DataFrame:
    return df.fillna(level, subset=list(columns))


def bind_columns(left: DataFrame, right: DataFrame, key: str = "ccn") -> DataFrame:
    """Column bind of two tables describing the same entities: a key join, never positions."""
    return left.join(right, key, "left")
