"""Bucketed radius join and grid kNN against brute force on random points (poles,
antimeridian, co-located and isolated points included)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facility_insights import schema as S
from facility_insights.operators import geo, knn, knn_blocks, knn_local

R = S.EARTH_RADIUS_KM * S.KM_TO_MILES


def hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def test_radius_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(float(rng.uniform(-89.9, 89.9)), float(rng.uniform(-180, 180))) for _ in range(150)]
    pts += [(float(rng.uniform(30, 31)), float(rng.uniform(-100, -99))) for _ in range(80)]
    pts += [(89.95, 10.0), (89.9, -170.0), (-89.97, 0.0), (10.0, 179.9), (10.1, -179.95), (45.0, 45.0), (45.0, 45.0)]
    rows = [(str(i), a, b) for i, (a, b) in enumerate(pts)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "ccn string, lat double, lng double")
    out = {r["ccn"]: r for r in geo.add_distance_features(df, lat_long=None).collect()}
    assert out["none"]["n_win_30"] is None and out["none"]["nearest"] is None
    for i, p in enumerate(pts):
        d = [hav(p, q) for j, q in enumerate(pts) if j != i]
        r = out[str(i)]
        assert r["n_win_30"] == sum(x < 30 for x in d)
        assert r["n_win_60"] == sum(x < 60 for x in d)
        assert r["n_win_90"] == sum(x < 90 for x in d)
        assert r["nearest"] == pytest.approx(min(d), abs=1e-6)
        assert r["n_win_30"] <= r["n_win_60"] <= r["n_win_90"]
        assert (r["nearest"] < 30) == (r["n_win_30"] >= 1)


def test_single_place_has_no_nearest(spark):
    df = spark.createDataFrame([("a", 10.0, 10.0)], "ccn string, lat double, lng double")
    r = geo.add_distance_features(df, lat_long=None).first()
    assert r["n_win_90"] == 0 and r["nearest"] is None


def _brute_knn(x: np.ndarray, keys, k: int):
    """Reference semantics: NaN-euclidean, donors having the feature, k nearest by (dist, group
    key, key); no donor -> column mean."""
    n, p = x.shape
    out = x.copy()
    means = np.nanmean(x, axis=0)
    gkey = {}
    for i in range(n):
        sig = tuple(np.where(np.isnan(x[i]), np.inf, x[i]))
        gkey.setdefault(sig, keys[i])
        gkey[sig] = min(gkey[sig], keys[i])
    for i in range(n):
        for f in range(p):
            if not np.isnan(x[i, f]):
                continue
            cands = []
            for j in range(n):
                if np.isnan(x[j, f]):
                    continue
                shared = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not shared.any():
                    continue
                d = math.sqrt(p / shared.sum() * float(np.sum((x[i, shared] - x[j, shared]) ** 2)))
                sig = tuple(np.where(np.isnan(x[j]), np.inf, x[j]))
                cands.append((d, gkey[sig], keys[j], x[j, f]))
            cands.sort()
            out[i, f] = np.mean([c[3] for c in cands[:k]]) if cands else means[f]
    return out


def test_knn_impute_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, p = 120, 3
    x = rng.normal(size=(n, p)).round(1)
    x[rng.random((n, p)) < 0.25] = np.nan
    x[5] = x[6] = x[7]  # a group of copies
    x[9] = np.nan  # no feature at all -> means
    keys = [f"k{i:04d}" for i in range(n)]
    rows = [(keys[i], *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "ccn string, a double, b double, c double")
    got = {r["ccn"]: (r["a"], r["b"], r["c"]) for r in knn.knn_impute(df, df, "ccn", ["a", "b", "c"], k=5).collect()}
    want = _brute_knn(x, keys, 5)
    for i in range(n):
        assert got[keys[i]] == pytest.approx(tuple(want[i]), abs=1e-9)


def test_knn_regress_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    tr = rng.normal(size=(200, 2)).round(2)
    y = rng.normal(size=200)
    te = rng.normal(size=(40, 2)).round(2)
    train = spark.createDataFrame([(f"t{i:03d}", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(tr, y))], "ccn string, a double, b double, y double")
    test = spark.createDataFrame([(f"q{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(te)], "ccn string, a double, b double")
    got = {r["ccn"]: r["prediction"] for r in knn.knn_regress(test, train, "ccn", ["a", "b"], "y", k=7).collect()}
    for i, q in enumerate(te):
        d = sorted((math.sqrt(float(np.sum((q - t) ** 2))), f"t{j:03d}", y[j]) for j, t in enumerate(tr))
        assert got[f"q{i:03d}"] == pytest.approx(np.mean([v for _, _, v in d[:7]]), abs=1e-9)


def _frame(spark, x, keys):
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(key, *[None if np.isnan(v) else float(v) for v in row]) for key, row in zip(keys, x)]
    return spark.createDataFrame(rows, "ccn string, " + ", ".join(f"{n} double" for n in names)), names


def _check_impute(spark, x, k=5):
    keys = [f"k{i:04d}" for i in range(len(x))]
    df, names = _frame(spark, x, keys)
    got = {r["ccn"]: [r[n] for n in names] for r in knn.knn_impute(df, df, "ccn", names, k=k).collect()}
    want = _brute_knn(x, keys, k)
    assert len(got) == len(x)
    for i, key in enumerate(keys):
        assert got[key] == pytest.approx(list(want[i]), abs=1e-9)


def test_knn_grid_with_hot_cell_and_copies(spark, monkeypatch):
    """The grid path alone: a third of the rows in one dense spot, copies, far outliers, a scarce feature, ties."""
    monkeypatch.setattr(knn, "SCARCE_DONORS", 0)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)).round(1), rng.normal(scale=0.01, size=(50, 4)).round(3), rng.normal(scale=50, size=(10, 4)), np.full((12, 4), 0.5)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[4:, 3] = np.nan  # fewer donors than k
    x[7] = np.nan
    _check_impute(spark, x)


@pytest.mark.parametrize("width", [13, 48])
def test_knn_of_wide_tables(spark, monkeypatch, width):
    """Blocks: more features than a grid or an integer mask takes, nulls, an almost-null and an all-null feature, copies."""
    monkeypatch.setattr(knn_blocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(70, width)).round(1)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[3:, 2] = np.nan
    x[20:40] = x[20]
    _check_impute(spark, x)


def test_block_bounds_are_below_every_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p, n = int(rng.integers(1, 8)), int(rng.integers(1, 6))
        q, d = rng.normal(size=(int(rng.integers(1, 6)), p)).round(1), rng.normal(loc=rng.normal(scale=3), size=(n, p)).round(1)
        for x in (q, d):
            x[rng.random(x.shape) < rng.choice([0, 0.3, 0.8])] = np.nan

        def entry(x):
            some = ~np.isnan(x)
            low, high = (np.where(some.any(axis=0), f(np.where(some, x, fill), axis=0), 0.0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
            return low, high, some.sum(axis=0), len(x), some.sum(axis=1).min()

        ql, qh, qn, qr, qm = entry(q)
        dl, dh, dn, dr, dm = entry(d)
        bound = knn_blocks.bounds({"low": ql, "high": qh, "have": qn, "rows": qr, "least": qm}, dl[None], dh[None], dn[None], np.array([dr]), np.array([dm]))[0]
        for a in q:
            for b in d:
                shared = ~np.isnan(a) & ~np.isnan(b)
                if shared.any():
                    assert bound <= math.sqrt(p / shared.sum() * ((a - b)[shared] ** 2).sum()) + 1e-9


def _wide(n, seed=4, width=13):
    """Features that follow from a hidden one; one group of them lacks together, another now and then."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 1)) @ rng.normal(size=(1, width)) + rng.normal(scale=0.02, size=(n, width))
    x[rng.random(n) < 0.3, :4] = np.nan
    x[rng.random(n) < 0.05, 7] = np.nan
    return x.round(3)


def test_pruned_blocks_equal_brute_force_and_grow_less_than_the_square(spark):
    joined = {}
    for n in (100, 400):
        x = _wide(n)
        keys = [f"k{i:04d}" for i in range(n)]
        df, names = _frame(spark, x, keys)
        donors = knn.prepare_donors(df, "ccn", names, names)
        need = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]), lambda i: i.isNotNull())
        q = df.select(F.col("ccn").alias("qkey"), F.lit("").alias("_g"), *[F.col(c).alias(f"q{j}") for j, c in enumerate(names)], need.alias("_need")).where(F.size("_need") > 0)
        counts = []
        found = knn_blocks.nearest(q, donors, len(names), len(names), 5, rows=5, counts=counts)
        means = {(r["qkey"], r["ti"]): r["v"] for r in found.groupBy("qkey", "ti").agg(F.avg("tv").alias("v")).collect()}
        if n == 100:
            want = _brute_knn(x, keys, 5)
            assert all(means[key, j] == pytest.approx(want[i][j], abs=1e-9) for i, key in enumerate(keys) for j in np.flatnonzero(np.isnan(x[i])))
        joined[n] = sum(counts)
    print("block pairs", joined)
    assert joined[400] < 9 * joined[100]  # the square: 16


def test_knn_of_empty_tables_and_nan(spark):
    schema = "ccn string, a double, b double"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("x", 1.0, None), ("y", float("nan"), 2.0), ("z", 1.5, 4.0)], schema)
    assert knn.knn_impute(none, some, "ccn", ["a", "b"]).count() == 0
    assert [r["b"] for r in knn.knn_impute(some, none, "ccn", ["a", "b"]).orderBy("ccn").collect()] == [None, 2.0, 4.0]
    got = {r["ccn"]: (r["a"], r["b"]) for r in knn.knn_impute(some, some, "ccn", ["a", "b"], k=1).collect()}
    assert got == {"x": (1.0, 4.0), "y": (1.5, 2.0), "z": (1.5, 4.0)}


def test_layout_by_pattern_keeps_results_and_bounds_copies(spark):
    """Each pattern's donors have its features alone, at most k of those alike in them; the nearest donors stay the same."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 3, 80).astype(float), rng.normal(size=80), rng.normal(size=80)]).round(2)
    x[:30, 1] = np.nan
    x[20:50, 2] = np.nan
    df, names = _frame(spark, x, [f"k{i:04d}" for i in range(80)])
    donors = knn.prepare_donors(df, "ccn", names, names)
    need = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]), lambda i: i.isNotNull())
    q = df.select(F.col("ccn").alias("qkey"), F.lit("").alias("_g"), *[F.col(c).alias(f"q{j}") for j, c in enumerate(names)], need.alias("_need")).where(F.size("_need") > 0)
    by_q, by_d = knn._by_pattern(q, donors, 3, 3, 2)
    patterns = {r["_g"].split("\u0001")[1] for r in by_q.collect()}
    assert patterns == {"101", "100", "110"}
    alike = {}
    for r in by_d.collect():
        pattern = r["_g"].split("\u0001")[1]
        assert all(r[f"d{j}"] is None for j in range(3) if pattern[j] == "0")
        key = (pattern, *[r[f"d{j}"] for j in range(3)], *[r[f"t{j}"] is None for j in range(3)])
        alike[key] = alike.get(key, 0) + 1
    assert max(alike.values()) == 2
    got, want = ({(r.qkey, r.ti): r.value for r in knn._block_search(a, b, 3, 3, 2).collect()} for a, b in ((by_q, by_d), (q, donors)))
    assert got == pytest.approx(want, abs=1e-12) and len(got) > 50


@pytest.mark.parametrize("width,lacks", [(3, 0.2), (4, 0.3), (13, 0.1), (13, 0.4)])
def test_search_in_one_step_equals_brute_force_and_blocks(spark, monkeypatch, width, lacks):
    """Groups and rows with bounds of their own: few and many patterns, ties, copies, a far row, a scarce feature."""
    monkeypatch.setattr(knn_local, "FEW", 3)
    monkeypatch.setattr(knn_local, "LEAF_ROWS", 4)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(150, width)).round(1)
    x[rng.random(150) < 0.3, 1] = np.nan
    x[rng.random(x.shape) < lacks * (rng.random((150, 1)) < 0.5)] = np.nan
    x[20:40], x[60, 0], x[5:, width - 1] = x[20], 1e6, np.nan
    keys = [f"k{i:04d}" for i in range(len(x))]
    donors = ~np.isnan(x)
    rank = np.argsort(np.argsort(keys))
    t, w = x.copy(), np.ones(len(x), dtype=np.int64)
    row, ti, value, weight = knn_local.search(x, ~donors, x, t, w, rank, 5)
    for r, i, v, n in zip(row, ti, value, weight, strict=True):
        shared = donors & donors[r]
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.sqrt(width / shared.sum(axis=1) * np.where(shared, (x - x[r]) ** 2, 0.0).sum(axis=1))
        near = sorted((dist[j], j) for j in range(len(x)) if donors[j, i] and shared[j].any())[:5]
        assert n == len(near) and v == pytest.approx(np.mean([x[j, i] for _, j in near]), abs=1e-9)
    assert set(zip(row, ti, strict=True)) == {(r, i) for r, i in zip(*np.nonzero(~donors), strict=True) if donors[r].any() and (donors[:, i] & (donors & donors[r]).any(axis=1)).any()}


def test_search_in_one_step_takes_each_group_and_weight(spark, monkeypatch):
    """Shares, groups without donors and weights: the same as by blocks."""
    rng = np.random.default_rng(2)
    rows = [(int(k % 4), f"k{k:03d}", *[None if rng.random() < 0.3 else float(rng.integers(0, 4)) for _ in range(3)]) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, ccn string, a double, b double, c double")
    fit, found = df.where("g < 3"), []
    monkeypatch.setattr(knn_local, "SHARE_ROWS", 10)
    for most in (knn_local.LOCAL_BYTES, 0):
        monkeypatch.setattr(knn_local, "LOCAL_BYTES", most)
        out = knn.knn_impute(df, fit, "ccn", ["a", "b", "c"], group="g")
        found.append({(r.g, r.ccn): (r.a, r.b, r.c) for r in out.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 200
    assert all(found[0][key] == pytest.approx(found[1][key], abs=1e-9) for key in found[0])


def test_rows_of_one_key_share_their_donors(spark, monkeypatch):
    """Repeated query keys give one value each, the same in one step as by blocks."""
    rng = np.random.default_rng(4)
    rows = [(f"k{k % 50:02d}", *[None if rng.random() < 0.3 else float(rng.integers(0, 9)) for _ in range(2)], float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ccn string, a double, b double, y double")
    found = []
    for most in (knn_local.LOCAL_BYTES, 0):
        monkeypatch.setattr(knn_local, "LOCAL_BYTES", most)
        out = knn.knn_target_means(df, df, "ccn", ["a", "b"], ["y"], None, 7).collect()
        found.append({r.ccn: (r.value, r.n_donors) for r in out})
        assert len(out) == len(found[-1])
    assert found[0].keys() == found[1].keys() and all(found[0][key] == pytest.approx(found[1][key]) for key in found[0])
