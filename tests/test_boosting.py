"""Histogram boosting against a plain search over all splits; stacked growth, leaf-wise growth, quantiles, attribution, saving."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from facility_insights.models import boosting
from facility_insights.models.boosting import HistogramBoosting, Settings, grow

NAMES = ["a", "b", "c"]


def table(seed=1, n=300):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 20, n) / 4, r.normal(size=n).round(1), r.integers(0, 5, n)]).astype(float)
    y = 3 * (x[:, 0] > 2) * x[:, 1] - x[:, 2] + r.normal(scale=0.1, size=n)
    x[r.random(n) < 0.1, 1] = np.nan
    return x, y.round(3)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table()
    given = [(k % 2, *[None if np.isnan(v) else float(v) for v in row], float(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(given, "g int, a double, b double, c double, y double").repartition(3).persist()


def split_of(x, grad, rows, s):
    """The best (gain, feature, threshold) over all values of all features."""
    g, h, best = grad[rows].sum(), len(rows), None
    for j in range(x.shape[1]):
        for cut in np.unique(x[rows, j][~np.isnan(x[rows, j])]):
            left = rows[x[rows, j] <= cut]
            gl, hl = grad[left].sum(), len(left)
            if min(hl, h - hl) < max(1, s.child_weight):
                continue
            gain = (gl**2 / (hl + s.penalty) + (g - gl) ** 2 / (h - hl + s.penalty) - g**2 / (h + s.penalty)) / 2 - s.gamma
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, j, cut)
    return best


def plain(x, y, s, rounds):
    """Trees one split after another; the largest gain first if the number of leaves is bounded."""
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        grad = score - y
        leaves = [(np.arange(len(y)), 0)]
        open_ = [(split_of(x, grad, leaves[0][0], s), 0)] if s.depth else []
        n_leaves = 1
        while any(b for b, _ in open_) and (s.leaves is None or n_leaves < s.leaves):
            at = max((k for k, (b, _) in enumerate(open_) if b), key=lambda k: open_[k][0][0])
            (_, j, cut), index = open_.pop(at)
            members, level = leaves[index]
            below = x[members, j] <= cut
            leaves[index] = (members[below], level + 1)
            leaves.append((members[~below], level + 1))
            n_leaves += 1
            for k in (index, len(leaves) - 1):
                if leaves[k][1] < s.depth:
                    open_.append((split_of(x, grad, leaves[k][0], s), k))
        for members, _ in leaves:
            score[members] -= s.rate * grad[members].sum() / (len(members) + s.penalty)
    return score


def predicted(rows, models, group=None):
    return {(r.g, r.a, r.b, r.c, r.y): r.prediction for r in boosting.predict(rows, models, NAMES, group=group).collect()}


@pytest.mark.parametrize("s", [Settings(rate=0.3, depth=3), Settings(rate=0.2, depth=4, child_weight=7, gamma=0.5), Settings(rate=0.3, depth=6, leaves=6)])
def test_trees_are_those_of_a_search_over_all_splits(rows, s):
    x, y = table()
    jobs = []
    found = grow(rows, NAMES, "y", [s], rounds=3, jobs=jobs)[0, 0]
    assert np.allclose(found.predict(x), plain(x, y, s, 3), atol=1e-8)
    assert max(jobs) <= s.depth


def test_stacked_models_are_those_of_single_fits(rows):
    members = [Settings(rate=0.3, depth=2), Settings(rate=0.1, depth=3, gamma=0.2)]
    stacked = grow(rows, NAMES, "y", members, group="g", rounds=2)
    x, y = table()
    for (g, member), model in stacked.items():
        mine = np.arange(len(y)) % 2 == g
        assert np.allclose(model.predict(x[mine]), plain(x[mine], y[mine], members[member], 2), atol=1e-8)
    assert sorted(stacked) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_columns_are_drawn_and_scores_rewritten(rows, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 2)
    s = Settings(rate=0.3, depth=2, columns=0.4)
    one, two = (grow(rows, NAMES, "y", [s], rounds=5)[0, 0] for _ in range(2))
    x, _ = table()
    assert np.array_equal(one.predict(x), two.predict(x))
    assert all(len(set(t["feature"][t["feature"] >= 0])) <= 1 for t in one.trees) and len({f for t in one.trees for f in t["feature"]}) > 2


def test_quantile_trees_reach_their_quantile(rows):
    x, y = table()
    model = grow(rows, NAMES, "y", [Settings(rate=0.3, depth=20, leaves=8, alpha=0.9)], rounds=8)[0, 0]
    assert 0.85 <= np.mean(y <= model.predict(x)) <= 0.95
    loss = lambda q: np.mean(np.maximum(0.9 * (y - q), -0.1 * (y - q)))
    assert loss(model.predict(x)) < 0.6 * loss(np.quantile(y, 0.9))


def test_contributions_add_up_and_tell_the_direction(spark, rows):
    x, y = table()
    model = grow(rows, NAMES, "y", [Settings(rate=0.3, depth=3)], rounds=3)[0, 0]
    assert np.allclose(model.contributions(x).sum(axis=1), model.predict(x) - model.mean)
    assert model.mean == pytest.approx(model.predict(x).mean())
    # a tree by hand: each step's change goes to the feature of the split
    t = model.trees[0]
    for row in x[:20]:
        node, parts = 0, np.zeros(3)
        while t["feature"][node] >= 0:
            child = t["left"][node] if row[t["feature"][node]] <= t["threshold"][node] else t["right"][node]
            parts[t["feature"][node]] += t["value"][child] - t["value"][node]
            node = child
        assert np.allclose(boosting.Ensemble(0.0, [t]).contributions(row[None])[0], parts)
    found = {r.feature: r for r in boosting.attribution(rows, model, NAMES).collect()}
    assert found["c"].direction == -1 and sum(r.importance for r in found.values()) == pytest.approx(1.0)
    parts = model.contributions(x)
    assert [found[n].mean_abs_contribution for n in NAMES] == pytest.approx(list(np.abs(parts).mean(axis=0)))


def test_saved_in_a_pipeline_and_empty_fits(spark, rows, tmp_path):
    model = Pipeline(stages=[HistogramBoosting(featureCols=NAMES, labelCol="y", rounds=2, settings='{"depth": 2}')]).fit(rows)
    model.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    key = lambda d: sorted((r.y, r.prediction) for r in d.collect())
    assert key(model.transform(rows)) == key(loaded.transform(rows))
    assert grow(rows.limit(0), NAMES, "y", rounds=2) == {}
    assert model.transform(rows.limit(0)).collect() == []


def test_rows_are_spread_over_free_cores(spark, monkeypatch):
    """A table below a task's rows still keeps more than one core busy, and a node's cells are one row of each task."""
    seen = []
    first_state = boosting._first_state

    def watched(rows, *rest):
        seen.append(rows.rdd.getNumPartitions())
        return first_state(rows, *rest)

    monkeypatch.setattr(boosting, "_first_state", watched)
    df = spark.range(20_000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("y"))
    boosting.grow(df, ["a"], "y", rounds=1)
    assert seen == [4]


@pytest.mark.parametrize("s", [Settings(rate=0.3, depth=4), Settings(rate=0.2, depth=9, child_weight=2, gamma=0.1, columns=0.7), Settings(rate=0.3, depth=6, leaves=9), Settings(rate=0.3, depth=20, leaves=8, alpha=0.9)])
def test_trees_of_one_task_are_those_of_jobs(rows, monkeypatch, s):
    """All trees of all models take one job; the same trees as a job a level gives."""
    jobs = []
    one = grow(rows, NAMES, "y", [s], group="g", rounds=4, jobs=jobs)
    assert sum(jobs) == 1 and len(jobs) == 4
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 0)
    many = grow(rows, NAMES, "y", [s], group="g", rounds=4, jobs=(levels := []))
    assert sum(levels) > 4
    x, _ = table()
    for key in ((0, 0), (1, 0)):
        assert np.allclose(one[key].predict(x), many[key].predict(x), atol=1e-9)
        assert [len(t["feature"]) for t in one[key].trees] == [len(t["feature"]) for t in many[key].trees]
        assert one[key].mean == pytest.approx(many[key].mean) and one[key].importances(3) == pytest.approx(many[key].importances(3))


def test_splits_of_met_cells_are_those_of_all_cells():
    r = np.random.default_rng(3)
    for s in (Settings(), Settings(child_weight=4, gamma=0.3)):
        slot, width = np.r_[np.arange(40), r.integers(0, 40, 400)], 30
        keys, grad = slot * width + r.integers(0, width, 440), r.normal(size=440)
        dense, sparse = (f(keys, grad, 40, width, s) for f in (boosting._dense_splits, boosting._sparse_splits))
        found = dense[0] > -np.inf
        assert found.any() and np.array_equal(found, sparse[0] > -np.inf) and np.array_equal(dense[1][found], sparse[1][found])
        assert all(np.allclose(a[found], b[found]) for a, b in zip(dense, sparse, strict=True)) and np.allclose(dense[4], sparse[4])


def test_search_errors_are_those_of_the_models(rows, monkeypatch):
    members = [Settings(rate=0.3, depth=3), Settings(rate=0.1, depth=5, columns=0.4)]
    fit, test = rows.where("c < 4"), rows.where("c >= 4")
    found = []
    for most in (boosting.LOCAL_BYTES, 0):
        monkeypatch.setattr(boosting, "LOCAL_BYTES", most)
        found.append({(r.member, r.g): r.mse for r in boosting.search_errors(fit, test, NAMES, "y", members, "g", rounds=3).collect()})
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 4
