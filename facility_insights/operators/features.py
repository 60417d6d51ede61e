"""Per-entity feature engineering. Every function is DataFrame -> DataFrame, so a
chain of them collapses into one projection (CollapseProject) inside one codegen stage; only the
min-max step needs a one-row aggregate, cross-joined as a broadcast (size: one row)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import safe_div


def per_beneficiary(
    df: DataFrame,
    bens: str = "distinct_bens",
    ratios: Mapping[str, str] | None = None,
    differences: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """``new = col / bens`` for each ratio and ``new = (a - b) / bens`` for each difference; x/0 -> NULL."""
    ratios = ratios if ratios is not None else {"total_charge_pb": "total_charge", "nurse_visit_ct_pb": "nurse_visit_ct"}
    differences = differences if differences is not None else {"charge_less_visits_pb": ("total_charge", "nurse_visit_ct")}
    new = {n: safe_div(c, bens) for n, c in ratios.items()}
    new.update({n: safe_div(F.col(a) - F.col(b), bens) for n, (a, b) in differences.items()})
    return df.withColumns(new)


def impute_demographics(
    df: DataFrame, columns: Sequence[str] = S.DEMOGRAPHIC_COLUMNS, threshold: float = S.DEMOGRAPHIC_FILL_THRESHOLD,
    white: str = "perc_white", nonwhite: str = "perc_nonwhite",
) -> DataFrame:
    """When the null-skipping sum of the shares is > threshold, NULL shares become 0; then
    ``nonwhite = 100 - white``."""
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    fill = total > F.lit(threshold)
    out = df.withColumns({c: F.when(fill, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c in columns})
    return out.withColumn(nonwhite, F.lit(100.0) - F.col(white))


def _bin_stems(df: DataFrame, top: str = "TBV", bottom: str = "BBV") -> list[str]:
    """Stems having both a top and a bottom bin column (paired by stem, not position)."""
    cols = set(df.columns)
    return [c[: -len(top)] for c in df.columns if c.endswith(top) and c[: -len(top)] + bottom in cols]


def reverse_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``1 - (x - min) / (max - min)`` with min/max over the whole table; constant column -> 1.

    The fit is a one-row aggregate (bounded size) cross-joined back as a broadcast.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    stats = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in columns], *[F.max(c).alias(f"_mx_{c}") for c in columns])
    j = df.crossJoin(F.broadcast(stats))
    new = {}
    for c in columns:
        rng = F.col(f"_mx_{c}") - F.col(f"_mn_{c}")
        rng = F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        new[c] = F.lit(1.0) - (F.col(c) - F.col(f"_mn_{c}")) / rng
    return j.withColumns(new).drop(*[f"_mn_{c}" for c in columns], *[f"_mx_{c}" for c in columns])


def quality_ratios(df: DataFrame, ratio_vars: Sequence[str] = S.RATIO_VARS) -> DataFrame:
    """``<stem>BTR = <stem>BBV / <stem>TBV`` for every stem, then reverse min-max on ``ratio_vars``."""
    new = {f"{s}BTR": safe_div(f"{s}BBV", f"{s}TBV") for s in _bin_stems(df)}
    return reverse_minmax(df.withColumns(new), ratio_vars)


def quality_adjusted(df: DataFrame) -> DataFrame:
    """``<stem>ADJ = <stem>TBV / (1 + 0.01 * <stem>BBV)`` for every stem."""
    new = {f"{s}ADJ": safe_div(f"{s}TBV", F.lit(1.0) + F.lit(S.ADJ_FACTOR) * F.col(f"{s}BBV")) for s in _bin_stems(df)}
    return df.withColumns(new)


def rating_estimate(df: DataFrame, stem: str = "RATING", out: str = "RATING_EST") -> DataFrame:
    """``.01*3.5*BBV + .01*7.5*MBV + .01*9.5*TBV``; NULL if any bin is NULL."""
    wb, wm, wt = S.RATING_BIN_WEIGHTS
    low = F.col(f"{stem}_BBV") * F.lit(0.01) * F.lit(wb)
    mid = F.col(f"{stem}_MBV") * F.lit(0.01) * F.lit(wm)
    high = F.col(f"{stem}_TBV") * F.lit(0.01) * F.lit(wt)
    return df.withColumn(out, low + mid + high)


def managed_scores(df: DataFrame, stems: Sequence[str] = S.MANAGED_STEMS, top_only: Sequence[str] = S.MANAGED_TOP_ONLY) -> DataFrame:
    """``MANAGED_<stem> = TBV + MBV``; stems without a middle bin take TBV."""
    new = {f"MANAGED_{s}": F.col(f"{s}_TBV") for s in top_only}
    new.update({f"MANAGED_{s}": F.col(f"{s}_TBV") + F.col(f"{s}_MBV") for s in stems})
    return df.withColumns(new)


def would_recommend(df: DataFrame, stem: str = "RECOMMEND", out: str = "would_recommend") -> DataFrame:
    return df.withColumn(out, F.col(f"{stem}_MBV") + F.col(f"{stem}_TBV"))


def for_profit_flag(df: DataFrame, column: str = "ownership", out: str = "for_profit") -> DataFrame:
    """1 when the ownership is 'For-Profit', else 0 (NULL included)."""
    return df.withColumn(out, F.coalesce((F.col(column) == F.lit(S.FOR_PROFIT_LEVEL)).cast("int"), F.lit(0)))


def chain(df: DataFrame, functions: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply feature functions in order (``DataFrame.transform``)."""
    return functools.reduce(lambda acc, f: acc.transform(f), functions, df)
