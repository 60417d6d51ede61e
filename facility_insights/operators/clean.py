"""Projection, filter, cast and cleaning operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import canonical_key, clean_numeric_text, null_tokens


def rename_by_dictionary(df: DataFrame, long_to_short: Mapping[str, str]) -> DataFrame:
    """Rename columns found in the dictionary; unmatched columns keep their names."""
    present = {k: v for k, v in long_to_short.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def filter_not_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(~F.col(column).contains(text))


def filter_not_in_keep_null(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Drop rows whose value is listed; rows with a NULL value stay (NOT IN would drop them)."""
    c = F.col(column)
    return df.where(c.isNull() | ~c.isin(list(values)))


def sentinels_to_null(df: DataFrame, tokens: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Exact-cell missing tokens -> NULL over the given (default: all string) columns."""
    tokens = list(tokens)
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: null_tokens(c, tokens) for c in columns})


def cast_columns(df: DataFrame, columns: Iterable[str], to: str = "double", strict: bool = False) -> DataFrame:
    """Cast listed columns. ``strict`` raises on bad text (like ``float``); else bad text -> NULL."""
    return df.withColumns({c: (F.col(c).cast(to) if strict else F.col(c).try_cast(to)) for c in columns})


def clean_numeric_columns(df: DataFrame, columns: Iterable[str], strict: bool = False) -> DataFrame:
    return df.withColumns({c: clean_numeric_text(c, strict) for c in columns})


def canonicalise_key(df: DataFrame, column: str = "ccn", via_float: bool = False) -> DataFrame:
    return df.withColumn(column, canonical_key(column, via_float))


def drop_all_null_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drop columns whose every value is NULL.

    One aggregate pass (partial counts per task, one row to the driver: a count per column).
    """
    keep = set(keep)
    candidates = [c for c in df.columns if c not in keep]
    if not candidates:
        return df
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in candidates]).first().asDict()
    return df.select([c for c in df.columns if c in keep or counts[c] > 0])
