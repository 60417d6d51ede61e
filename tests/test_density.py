"""Density curves from sketches against the plain sum over all values."""

import math
import random

import numpy as np

from facility_insights.operators import distribution


def test_curves_are_within_the_stated_bound(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1), 3.0, None])) for _ in range(500)] + [("one", 7.5), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {}
    for row in distribution.density_curves(df, "v", "g", cells=64).collect():
        found.setdefault((row.scope, row.g), {})[row.point] = (row.x, row.density)
    groups = {("national", None): [v for _, v in rows if v is not None]} | {("state", g): [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert set(found) == set(groups)
    for key, values in groups.items():
        x = np.array(values)
        sd = x.std(ddof=1) if len(x) > 1 and x.std() > 1e-9 else 1.0
        h = sd * len(x) ** -0.2
        bound = ((x.max() - x.min()) / 64 / h) ** 2 / (8 * h * math.sqrt(2 * math.pi)) + 1e-12
        assert len(found[key]) == 100
        for point, (at, density) in found[key].items():
            assert abs(at - (x.min() + point * (x.max() - x.min()) / 99)) < 1e-9
            assert abs(density - np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))) <= bound
    assert distribution.density_curves(df.limit(0), "v", "g").collect() == []
