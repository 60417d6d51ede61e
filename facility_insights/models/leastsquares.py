"""Least squares by tree-reduced QR.

Each task turns its rows of (1, features, label) into one small triangular R, batch by batch. The tasks' factors
are stacked ``FAN`` at a time and factored again, level by level, until a group has one. R has the singular values of the rows
themselves, so nothing is squared: columns of very different size, nearly dependent ones, and full sets of dummies
beside an intercept keep their digits. The solution is the one of least norm, so dependent columns share their
weight. Rows with a null or NaN in a feature or the label are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors that are stacked in one step.
FAN = 16
#: Rows that are added to a task's factor at once.
SLAB = 4_096
#: Singular values below this share of the largest one count as none.
RANK = 1e-11

SCHEMA = "g int, part int, i int, r array<double>"


def _stacked(g: int, part: int, r: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"g": g, "part": part, "i": np.arange(len(r)), "r": list(r)})


def factors(df: DataFrame, features: Sequence[str], label: str, group: str | None = None) -> dict[int, np.ndarray]:
    """R of (1, features, label) for each group."""
    g = F.col(group).cast("int") if group else F.lit(0)
    rows = df.select(g.alias("g"), *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate([*features, label])])

    def local(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.dropna().groupby("g"):
                z = np.column_stack([np.ones(len(part)), part.drop(columns="g").to_numpy(dtype=float)])
                for at in range(0, len(z), SLAB):
                    block = z[at : at + SLAB]
                    held[key] = np.linalg.qr(np.vstack([held[key], block]) if key in held else block, mode="r")
        for key, r in held.items():
            yield _stacked(int(key), TaskContext.get().partitionId(), r)

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "i"])  # the same order in a retried task
        return _stacked(int(key[0]), int(key[1]), np.linalg.qr(np.stack(rows["r"].to_list()), mode="r"))

    found, parts = rows.mapInPandas(local, SCHEMA), rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("g", "part").applyInPandas(merged, SCHEMA)
    out: dict[int, list] = {}
    for row in found.orderBy("g", "part", "i").collect():  # groups x (features + 2) rows
        out.setdefault(row["g"], []).append(row["r"])
    return {key: np.linalg.qr(np.array(r), mode="r") for key, r in out.items()}


def solve(r: np.ndarray, features: Sequence[str]) -> dict[str, float]:
    """Coefficients of least norm from R; the intercept is a column like any other."""
    beta = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=RANK)[0]
    return {"intercept": float(beta[0]), **{f: float(b) for f, b in zip(features, beta[1:], strict=True)}}


def fit(df: DataFrame, features: Sequence[str], label: str, group: str | None = None) -> dict[int, dict[str, float]]:
    """{group: {'intercept': b0, feature: b}}; groups without complete rows are left out. Without ``group`` all rows are group 0."""
    return {key: solve(r, features) for key, r in sorted(factors(df, features, label, group).items())}


def coefficient_table(spark, coefs: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(coefs.items()), "feature string, coefficient double")
