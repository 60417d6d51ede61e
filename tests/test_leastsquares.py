"""Tree-reduced least squares against plain NumPy on dependent and badly scaled columns."""

import numpy as np
import pytest

from facility_insights.models import leastsquares


def frame(spark, x, y, g=None):
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(int(k if g is None else g[k]), *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names) + ", y double"), names


def test_dummies_beside_an_intercept(spark):
    r = np.random.default_rng(1)
    level, flag = r.integers(0, 4, 300), r.integers(0, 2, 300)
    x = np.column_stack([np.eye(4)[level], flag, 1 - flag, r.normal(size=300)])
    y = x @ [1, 2, 3, 4, 5, 6, 7] + 0.5 + r.normal(scale=0.1, size=300)
    df, names = frame(spark, x, y)
    got = leastsquares.fit(df.repartition(40), names, "y")[0]  # three levels of the tree
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert [got["intercept"], *(got[n] for n in names)] == pytest.approx(list(want), abs=1e-9)


def test_columns_of_very_different_size_keep_their_digits(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=400)
    x = np.column_stack([a * 1e6 + 1e5, a + r.normal(scale=1e-3, size=400), r.normal(size=400) * 1e-3])
    true = np.array([2e-6, -3.0, 500.0])
    df, names = frame(spark, x, x @ true + 7.0)
    got = leastsquares.fit(df, names, "y")[0]
    assert [got[n] for n in names] == pytest.approx(list(true), rel=1e-3)
    # the normal equations lose them
    z = np.column_stack([np.ones(400), x])
    normal = np.linalg.lstsq(z.T @ z, z.T @ (x @ true + 7.0), rcond=None)[0][1:]
    assert not np.allclose(normal, true, rtol=1e-3)


def test_groups_gaps_and_empty_tables(spark):
    r = np.random.default_rng(3)
    x, g = r.normal(size=(90, 2)), np.arange(90) % 3
    y = x @ [1.0, -2.0] + g
    x[5] = np.nan
    df, names = frame(spark, x, y, g)
    got = leastsquares.fit(df.repartition(7), names, "y", "g")
    for k in range(3):
        assert [got[k]["intercept"], got[k]["f0"], got[k]["f1"]] == pytest.approx([k, 1.0, -2.0], abs=1e-10)
    assert leastsquares.fit(df.limit(0), names, "y") == {}
    assert leastsquares.fit(df.limit(1), names, "y", "g")  # fewer rows than columns
