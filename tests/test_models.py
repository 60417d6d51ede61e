"""Model queries run on the smallest tables; planted signals and seeds for the tree models."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from facility_insights import schema as S
from facility_insights.models import boosting, evaluate, regress
from facility_insights.operators import reshape

from .conftest import SMALL


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(str(k), float(k % 10), float(k * 7 % 13), 3.0 * (k % 10) + k * 31 % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, a double, b double, y double")
    return df.withColumn("part", F.when(F.col("key").cast("int") % 4 == 0, "test").otherwise("train")).persist()


def test_boosting_finds_the_signal_and_repeats(planted):
    train, test = planted.where("part = 'train'"), planted.where("part = 'test'")
    one, two = (boosting.predict(test, {0: boosting.grow(train, ["a", "b"], "y", [boosting.Settings(rate=0.3)], rounds=8)[0, 0]}, ["a", "b"]).select("key", "prediction", "y") for _ in range(2))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert regress.metrics(one, "y").first()["r2"] > 0.9


def test_permutation_tells_the_used_feature(planted):
    model = boosting.grow(planted.where("part = 'train'"), ["a", "b"], "y", [boosting.Settings(rate=0.3)], rounds=5)[0, 0]
    found = evaluate.permutation_importance(planted.where("part = 'test'"), "key", ["a", "b"], "y", lambda d: boosting.predict(d, {0: model}, ["a", "b"]))
    loss = {r.feature: r.mse_increase for r in found.collect()}
    assert loss["a"] > 20 * abs(loss["b"])


def test_the_search_ranks_as_single_fits_do(spark, planted):
    st = evaluate.stack_folds(planted.select("key", "a", "b", "y"), "key", folds=2)
    jobs = []
    found = {r.draw: (r.mean_test_mse, r["rank"]) for r in evaluate.random_search(st, ["a", "b"], "y", draws=3, rounds=2, jobs=jobs).collect()}
    drawn = evaluate.draw_grid(S.SEARCH_GRID, 3)
    single = []
    for number, d in enumerate(drawn):
        errors = []
        for g in (0, 1):
            rows = st.where(F.col("g") == g)
            # a member's columns are drawn by its number
            members = [boosting.Settings.of(d)] * (number + 1)
            model = boosting.grow(rows.where("part = 'train'"), ["a", "b"], "y", members, group="g", rounds=2)[g, number]
            errors.append(regress.metrics(boosting.predict(rows.where("part = 'test'"), {0: model}, ["a", "b"]), "y").first()["mse"])
        single.append(sum(errors) / 2)
    assert [found[k][0] for k in range(3)] == pytest.approx(single)
    assert [found[k][1] for k in range(3)] == [1 + sorted(single).index(v) for v in single]
    assert len(jobs) == 2 and max(jobs) <= max(d["max_depth"] for d in drawn)


def test_the_search_grows_whole_models(spark, planted):
    """Every drawn model has as many trees as a single one."""
    st = evaluate.stack_folds(planted.select("key", "a", "b", "y"), "key", folds=2)
    evaluate.random_search(st, ["a", "b"], "y", draws=2, jobs=(jobs := []))
    assert len(jobs) == S.BOOST_ROUNDS == 100


def test_the_prediction_job_grows_whole_models(spark, monkeypatch):
    """The search's models and the two that are saved have as many trees as a single model."""
    from facility_insights.plans import registry

    saved, searched = [], []
    reloaded, search = registry._reloaded, evaluate.random_search
    monkeypatch.setattr(registry, "_reloaded", lambda spark, model, name: saved.append(reloaded(spark, model, name)) or saved[-1])
    monkeypatch.setattr(evaluate, "random_search", lambda *a, **b: search(*a, **b, jobs=searched))
    assert registry.QUERIES["train_prediction"](spark, SMALL).count() > 0
    assert [len(model.stages[-1].ensemble.trees) for model in saved] == [S.BOOST_ROUNDS] * 2 and len(searched) == S.BOOST_ROUNDS


def test_components_are_standardised(spark):
    df = E.queries()["group_components"](spark, SMALL)
    r = df.agg(F.avg("activity").alias("m"), F.stddev_pop("activity").alias("s")).first()
    assert abs(r.m) < 1e-5 and abs(r.s - 1) < 1e-5


def test_reports_have_a_row_for_each_model_and_split(spark, planted):
    rows = planted.select("key", "a", "b", F.when(F.col("key").cast("int") % 9 > 0, F.col("y")).alias("y"))
    cv = evaluate.cv_compare(rows.where("y is not null"), "key", ["a", "b"], "y", folds=2, models=("lr", "quantile"), rounds=2).collect()
    resample = evaluate.resample_eval(rows, "key", ["a", "b"], "y", splits=2, models=("lr", "knn", "gbt"), rounds=2).collect()
    assert [r.model for r in cv] == ["lr", "quantile"] and cv[0].test_r2 > 0.8
    assert sorted((r.model, r.split) for r in resample) == [(m, s) for m in ("gbt", "knn", "lr") for s in (0, 1)]


def test_insight_models_come_back_from_the_shared_folder(spark):
    assert {r.target for r in E.queries()["train_insight"](spark, SMALL).collect()} == set(S.TARGETS)


def test_export_has_the_training_rows(spark):
    df = E.queries()["export_training"](spark, SMALL)
    assert df.columns[0] == "y1" and df.count() > 0 and df.where(" or ".join(f"{c} is null" for c in df.columns)).count() == 0


def test_a_repeated_cell_raises(spark):
    df = spark.createDataFrame([("1", "A", "10"), ("1", "A", "20")], "ccn string, code string, score string")
    with pytest.raises(Exception, match="repeated cell"):
        reshape.pivot_measures(df, levels=["A", "B"]).collect()


def test_level_discovery_is_bounded(spark):
    with pytest.raises(ValueError, match="too many levels"):
        reshape.discover_levels(spark.range(5 * S.MAX_LEVELS).select(F.col("id").cast("string").alias("c")), ["c"])


def test_least_squares_per_group_of_a_wide_table(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 48))
    g, true = np.arange(300) % 2, rng.normal(size=48)
    y = x @ true + g * 2.0 + 1.0
    names = [f"f{j}" for j in range(48)]
    rows = [(int(a), *map(float, v), float(b)) for a, v, b in zip(g, x, y)] + [(0, *([None] * 48), 9.0), (1, *([0.0] * 48), None)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    coefs = evaluate.group_ols(df, names, "y")
    assert sorted(coefs) == [0, 1]
    for a in (0, 1):
        assert coefs[a]["intercept"] == pytest.approx(1.0 + 2.0 * a, abs=1e-8)
        assert [coefs[a][n] for n in names] == pytest.approx(list(true), abs=1e-8)


def test_scale_impute_of_a_row_in_both_tables(spark):
    from facility_insights.plans.registry import scale_impute

    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, None), ("c", 4.0, 7.0)], "ccn string, u double, v double")
    one, two, _ = scale_impute(df, df.where("ccn = 'b'"), ["u", "v"])
    found = {r["ccn"]: (r["u"], r["v"]) for r in one.collect()}
    assert len(found) == 3 and found["b"][1] == pytest.approx(0.0, abs=1e-9)
    assert [(r["u"], r["v"]) for r in two.collect()] == [found["b"]]


def test_cached_tables_are_kept_and_given_back(spark):
    from facility_insights.sources import files

    tables = files.load_cached(spark, {"region": f"{SMALL}/region.parquet", "nation": f"{SMALL}/nation.parquet"})
    assert all(t.storageLevel.useMemory for t in tables.values()) and tables["region"].count() == 5
    for t in tables.values():
        t.unpersist()
        assert not t.storageLevel.useMemory
