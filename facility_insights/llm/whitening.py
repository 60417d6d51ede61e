"""Whitening of embeddings by shifted CholeskyQR.

Entries are put on a grid of whole numbers, x = floor(scale * c), so that sums are exact and rows can be
compared. The fit list holds each distinct x vector once. X is the fit list less its mean, a row for
each vector. One pass over the fit list sums the Gram matrix of X in every task and adds the tasks'
matrices up; a small shift on its diagonal makes the first Cholesky factor safe however badly X is
conditioned. The next passes orthogonalise: each row of X is solved through the triangular factors so
far, and the Gram matrix of what comes out is factored again. R, the product of the factors, has
R'R = X'X to working precision, without the squared condition number of X'X itself; the singular
vectors of R are the components, its squared singular values over n their eigenvalues.

A task holds a batch of rows and one matrix of d x d numbers, the driver a few such matrices.

Rows whose vector is null, or holds a null, NaN or infinite entry or one whose x is no long, are dropped. So are
empty vectors and those of another length than most (of lengths equally common, the longest counts). Rows without an id and repeated rows stay.
If there are fewer dimensions or components of a variance above rounding than asked for, the others are left out where they are
beyond the dimensions, and have null for ``whitened`` and 0 for ``explained`` where they have no variance. A
deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facility_insights.session import scratch_path

#: Entries are multiplied by this before they are rounded down.
SCALE = 256
#: Orthogonalising ends when no entry of the Gram matrix is farther than this from the identity's, or after so many passes.
CLOSE, PASSES = 1e-13, 6
#: Rows that are worked on at once.
SLAB = 8192
#: Columns that are solved at once.
STRIP = 32


@dataclass(frozen=True)
class Whitening:
    """Fitted parameters: rows and exact sums of the fit list, components in rows, their eigenvalues, trace and measured error."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _grid(vectors: pa.Array, width: int | None, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, x): which rows of a list column can be used, and their x as 64-bit integers.

    Without a width, rows of every length that is above 0 count as kept and x is empty.
    """
    sizes = np.array([-1 if k is None else k for k in pa.compute.list_value_length(vectors).to_pylist()], dtype=np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(values * scale)
        good = np.isfinite(x) & (x >= -(2.0**63)) & (x < 2.0**63)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    bad = np.concatenate([[0], np.cumsum(~good)])
    kept = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    if width is None:
        return kept, np.zeros((0, 0), dtype=np.int64)
    kept &= sizes == width
    return kept, x[np.repeat(kept, np.maximum(sizes, 0))].astype(np.int64).reshape(-1, width)


def _matrix(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """A list column without nulls as matrices of at most SLAB rows."""
    whole = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for at in range(0, len(whole), SLAB):
        yield whole[at : at + SLAB]


def _width(table: DataFrame, vector_col: str, scale: int) -> int:
    """The commonest length of the vectors that can be used; 0 if there is none."""

    def run(rows):
        for b in rows:
            kept, _ = _grid(b.column(0), None, scale)
            yield pa.RecordBatch.from_arrays([b.filter(pa.array(kept)).column(0).value_lengths()], names=["width"])

    found = table.select(vector_col).mapInArrow(run, "width int").groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else 0


def fit_list(table: DataFrame, width: int, *, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(x): each distinct x vector once. Copies meet in their own task before the shuffle."""

    def run(rows):
        for b in rows:
            kept, x = _grid(b.column(0), width, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["x"])

    return table.select(vector_col).mapInArrow(run, "x array<long>").distinct()


def _gram(rows: DataFrame, width: int, solve) -> np.ndarray:
    """Sum of Y'Y, Y being solve(x) for the fit list: a matrix for each task, added up by its entries' places."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            for x in _matrix(b.column(0), width):
                y = solve(x)
                total += y.T @ y
        i, j = np.triu_indices(width)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "g"])

    out = np.zeros((width, width))
    for row in rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # width^2 / 2 numbers
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["g"]
    return out


def _sums(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums: Python integers for each batch, decimals between tasks."""

    def run(batches):
        n, total = 0, [0] * width
        for b in batches:
            for x in _matrix(b.column(0), width):
                n += len(x)
                wide = len(x) * int(np.abs(x.astype(np.float64)).max(initial=0)) >= 2**62
                total = [s + int(v) for s, v in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([str(n), *map(str, total)])], names=["i", "s"])

    found = dict(rows.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return int(found.get(-1, 0)), tuple(int(found.get(i, 0)) for i in range(width))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n. Whole numbers below 2^53 are exact doubles, so only the division rounds."""
    return x.astype(np.float64) - np.array([s / n for s in sums])


def _solved(y: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    """Y R^-1 for each upper triangular factor in order, by substitution of STRIP columns at a time from the first on."""
    for upper in factors:
        out = np.empty_like(y)
        for j in range(0, len(upper), STRIP):
            strip = slice(j, j + STRIP)
            out[:, strip] = np.linalg.solve(upper[strip, strip].T, (y[:, strip] - out[:, :j] @ upper[:j, strip]).T).T
        y = out
    return y


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift if asked for or if it breaks down without."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + (shift if shifted else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift, shifted = (shift * 2 if shifted else shift), True


def triangular(rows: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred fit list, by a shifted Cholesky pass and repeated ones on what it leaves."""
    width = len(sums)
    r, factors = np.eye(width), ()
    for number in range(PASSES):
        gram = _gram(rows, width, lambda x, f=factors: _solved(_centred(x, n, sums), f))
        if number == 0 and not gram.any():
            return np.zeros((width, width))
        # directions without variance have a Gram entry of about 0 for good
        if number and np.abs(gram - np.eye(width)).max() <= CLOSE:
            break
        factors = (*factors, _factor(gram, n, shifted=number == 0))
        r = factors[-1] @ r
    return r


def fit(table: DataFrame, *, vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> Whitening | None:
    """The whitening of a table's vectors; None if no row can be used."""
    spark = table.sparkSession
    width = _width(table, vector_col, scale)
    if not width:
        return None
    held = scratch_path(spark, "whitening-fit")
    fit_list(table, width, vector_col=vector_col, scale=scale).write.parquet(held)  # every pass reads it
    rows = spark.read.parquet(held)
    n, sums = _sums(rows, width)
    r = triangular(rows, n, sums)
    _, sigma, vt = np.linalg.svd(r)
    eigenvalues = sigma**2 / n
    trace = float(eigenvalues.sum())
    # R is exact to rounding, so a value below that is a direction without variance
    eigenvalues = np.where(sigma > sigma[0] * width * np.finfo(float).eps * 8, eigenvalues, 0.0)
    model = Whitening(n, sums, vt[:components], eigenvalues[:components], trace, None)
    return Whitening(n, sums, model.components, model.eigenvalues, trace, _error(rows, model))


def _project(centred: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of the components that have variance."""
    live = model.eigenvalues > 0
    return centred @ (model.components[live] / np.sqrt(model.eigenvalues[live])[:, None]).T


def _error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the fit list's whitened covariance less the identity; None without variance."""
    live = int((model.eigenvalues > 0).sum())
    if not live:
        return None
    n, sums, width = model.n, model.sums, len(model.sums)

    def run(batches):
        total = np.zeros((live + 1, live + 1))  # with a column of ones, for the means
        for b in batches:
            for x in _matrix(b.column(0), width):
                y = np.column_stack([_project(_centred(x, n, sums), model), np.ones(len(x))])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(live + 1, dtype=np.int32), live + 1)), pa.array(np.tile(np.arange(live + 1, dtype=np.int32), live + 1)), pa.array(total.ravel())], names=["i", "j", "g"])

    got = np.zeros((live + 1, live + 1))
    for row in rows.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        got[row["i"], row["j"]] = row["g"]
    means = got[:live, live] / n
    return float(np.abs(got[:live, :live] / n - np.outer(means, means) - np.eye(live)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    most = n * max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) + max(map(abs, sums))
    if len(sums) * most * most < 2.0**62:
        far = x * n - np.array(sums, dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    far = x.astype(object) * n - np.array(sums, dtype=object)
    return [v if v < 2**63 else None for v in (far * far).sum(axis=1).tolist()]


def whiten(table: DataFrame, model: Whitening | None, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    given = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_vector"))
    out = given.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.rsplit(" ", 1) for x in SCHEMA.split(", "))])
    if model is None:
        return out.limit(0)
    width, live = len(model.sums), model.eigenvalues > 0
    k, names = len(live), out.columns

    def run(rows):
        for b in rows:
            kept, x = _grid(b.column(1), width, scale)
            ids = b.column(0).filter(pa.array(kept))
            for at in range(0, len(x), SLAB):
                part = x[at : at + SLAB]
                m = len(part)
                white = np.full((m, k), np.nan)
                white[:, live] = _project(_centred(part, model.n, model.sums), model)
                explained = model.eigenvalues / model.trace if model.trace else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, dtype=np.int64)),
                        pa.array([v for v in _deviations(part, model.n, model.sums) for _ in range(k)], pa.int64()),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, m)),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    names=names,
                )

    return given.mapInArrow(run, out.schema)
