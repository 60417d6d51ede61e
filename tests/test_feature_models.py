"""Models on the feature table, run on the smallest tables."""

import numpy as np
import pytest

from facility_insights import schema as S
from facility_insights.plans import feature_models

from .conftest import SMALL


@pytest.fixture(scope="module")
def table(spark):
    columns = dict.fromkeys([*S.INSIGHT_FEATURES, *S.INSIGHT_TARGETS, S.OBSERVED_COLUMN])
    return feature_models.stored_features(spark, SMALL, list(columns))


@pytest.fixture(scope="module")
def explained(spark, table):
    contrib, predicted = feature_models.explained(spark, table, "would_recommend")
    return contrib.toPandas(), predicted.toPandas().set_index("ccn")


def test_contributions_add_up_to_the_prediction(spark, table, explained):
    contrib, predicted = explained
    rest = predicted["predicted"] - contrib.groupby("ccn")["contribution"].sum()
    assert set(contrib.groupby("ccn").size()) == {len(S.INSIGHT_FEATURES)}
    assert np.ptp(rest.to_numpy()) < 1e-9  # what is left is the intercept


def test_scores_are_the_known_ones_and_filled_where_missing(table, explained):
    contrib, _ = explained
    shown = contrib.pivot(index="ccn", columns="feature", values="your_score")
    known = table.toPandas().set_index("ccn").loc[shown.index, S.INSIGHT_FEATURES].astype(float)
    assert not shown.isna().any().any() and known.isna().any().any()
    assert np.nanmax(np.abs(shown[S.INSIGHT_FEATURES].to_numpy() - known.to_numpy()) / (1 + np.abs(known.to_numpy()))) < 1e-12
    flag = contrib[contrib["feature"] == "for_profit"]
    assert set(flag["z"]) <= {0.0, 1.0} and (flag["z"] == flag["your_score"]).all()


def test_coefficients_are_the_least_squares_ones(explained):
    contrib, predicted = explained
    z = contrib.pivot(index="ccn", columns="feature", values="z")[S.INSIGHT_FEATURES]
    design = np.column_stack([np.ones(len(z)), z.to_numpy()])
    best = np.linalg.lstsq(design, predicted.loc[z.index, "actual"].to_numpy(float), rcond=None)[0]
    found = contrib.groupby("feature")["coefficient"].first()[S.INSIGHT_FEATURES]
    assert found.to_numpy() == pytest.approx(best[1:], abs=1e-8)


def test_rows_are_imputed_once(spark, table, monkeypatch):
    """Labelled and observed rows go through one neighbour search for each target."""
    from facility_insights.operators import knn

    searches, search = [], knn.knn_target_means
    monkeypatch.setattr(knn, "knn_target_means", lambda *a, **b: searches.append(1) or search(*a, **b))
    feature_models.explained(spark, table, "would_recommend")[1].count()
    assert len(searches) == 1
