"""Models on the feature table (P6 -> P7, K2-K5): the merged and engineered features go straight into the saved pipelines.

The feature table is written once to the shared folder with the columns the models read. For each target one
pipeline of scaler, imputer and least squares is fitted on the labelled rows, saved and read again; coefficients,
contributions and recommendations come from the model that was read. Where entities' rows are shown too, labelled and
observed rows are imputed together, once. Entities without survey answers are left to
the prediction model. The SQL does the same by all-pairs distances and Gram-Schmidt.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..models import regress
from ..operators import insight
from ..session import scratch_path
from . import registry as reg

_F = S.INSIGHT_FEATURES


def stored_features(spark, sf_dir: str, columns) -> DataFrame:
    """The feature table's key and ``columns``, written to the shared folder and read again: every fit scans only what it needs."""
    path = scratch_path(spark, "features")
    reg.features_table(spark, sf_dir).select("ccn", *columns).write.parquet(path)
    return spark.read.parquet(path)


def _table(spark, sf_dir: str) -> DataFrame:
    return stored_features(spark, sf_dir, [*_F, *S.INSIGHT_TARGETS, S.OBSERVED_COLUMN])


def fit_insight(spark, table: DataFrame, target: str) -> PipelineModel:
    """Scaler (flag left as it is), imputer and least squares fitted on all labelled rows; saved, then read."""
    rows = table.where(F.col(target).isNotNull()).select("ccn", *_F, target)
    return reg._reloaded(spark, reg.preprocessing(_F, "ccn", *_least_squares(target), exclude=S.INSIGHT_UNSCALED).fit(rows), f"insight_{target}")


def _least_squares(target: str) -> list:
    return [VectorAssembler(inputCols=_F, outputCol="features"), LinearRegression(featuresCol="features", labelCol=target, solver="normal", standardization=False)]


def fit_and_fill(spark, table: DataFrame, target: str) -> tuple[PipelineModel, DataFrame]:
    """The same pipeline, and the labelled and the observed rows as its scaler and imputer, read again, give them: each row is imputed once."""
    rows = table.select("ccn", *_F, target, S.OBSERVED_COLUMN).where(F.col(target).isNotNull() | F.col(S.OBSERVED_COLUMN).isNotNull())
    labelled = F.col(target).isNotNull()
    first = reg._reloaded(spark, reg.preprocessing(_F, "ccn", exclude=S.INSIGHT_UNSCALED).fit(rows.where(labelled)), f"insight_rows_{target}")
    filled = reg.cut_lineage_df(first.transform(rows))
    last = Pipeline(stages=_least_squares(target)).fit(filled.where(labelled))
    return reg._reloaded(spark, PipelineModel([*first.stages, *last.stages]), f"insight_{target}"), filled


def _coefficients(spark, model: PipelineModel) -> dict[str, float]:
    return {r.feature: r.coefficient for r in regress.coefficient_table(spark, model.stages[-1], _F).collect()}  # one row a feature


def _for_targets(one, spark, table: DataFrame) -> DataFrame:
    out = None
    for target in S.INSIGHT_TARGETS:
        found = one(spark, table, target).select(F.lit(target).alias("target"), "*")
        out = found if out is None else out.unionByName(found)
    return reg.r6(out)


def explained(spark, table: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """K3 of the observed entities, and (ccn, predicted, actual): from the same scaled and imputed rows."""
    model, filled = fit_and_fill(spark, table, target)
    scaler = model.stages[0]
    coefs = _coefficients(spark, model)
    z = filled.where(F.col(S.OBSERVED_COLUMN).isNotNull()).select("ccn", *_F, F.col(target).alias("actual"))
    fitted = scaler.params_of()
    unscaled = {f: F.col(f) * fitted[f][1] + fitted[f][0] if f in fitted else F.col(f).cast("double") for f in _F}
    rows = z.withColumns({f"_raw_{f}": v for f, v in unscaled.items()})
    table_of = insight.coefficient_table(spark, coefs, S.INSIGHT_LABELS)
    contrib = insight.contributions(rows, {f: f"_raw_{f}" for f in _F}, "ccn", table_of, insight.column_means(table, _F))
    return contrib, z.select("ccn", regress.linear_prediction(coefs, _F).alias("predicted"), "actual")


def _insight(spark, table, target):
    return insight.coefficient_table(spark, c := _coefficients(spark, fit_insight(spark, table, target)), S.INSIGHT_LABELS).unionByName(
        spark.createDataFrame([("intercept", "intercept", c["intercept"])], "feature string, label string, coefficient double")
    )


def _contributions(spark, table, target):
    return explained(spark, table, target)[0].select("ccn", "feature", "label", "your_score", "mean_score", "coefficient", "z", "contribution")


def _recommendations(spark, table, target):
    contrib, predicted = explained(spark, table, target)
    return insight.recommendations(contrib, "ccn", S.ACTIONABLE_FEATURES, predicted)


def _model_sql(target: str) -> str:
    """CTEs of one target: z (scaled), zi (imputed), coef (b_<feature>, b0)."""
    t, p = reg.Q.q(target), len(_F)
    scaled = ", ".join(c if c in S.INSIGHT_UNSCALED else f"({c} - m_{c}) / s_{c} AS {c}" for c in _F)
    items = " UNION ALL ".join(f"SELECT pd.qk, '{c}' AS target, pd.d_{c} AS tv, pd.dist, pd.gk, pd.dk FROM pd JOIN q ON pd.qk = q.ccn WHERE q.{c} IS NULL AND pd.d_{c} IS NOT NULL" for c in _F)
    filled = ", ".join(f"coalesce(z.{c}, (SELECT v FROM im WHERE im.qk = z.ccn AND im.target = '{c}'), mu_{c}) AS {c}" for c in _F)
    steps = ["g0 AS (SELECT y - avg(y) OVER () AS y, " + ", ".join(f"{c} - avg({c}) OVER () AS a{i}, {c} - avg({c}) OVER () AS q{i}" for i, c in enumerate(_F)) + " FROM zi WHERE y IS NOT NULL)"]
    for j in range(p - 1):
        later = "".join(f", q{k} - sum(q{k} * q{j}) OVER () / sum(q{j} * q{j}) OVER () * q{j} AS q{k}" for k in range(j + 1, p))
        steps.append(f"g{j + 1} AS (SELECT y, " + ", ".join(f"a{i}" for i in range(p)) + "".join(f", q{i}" for i in range(j + 1)) + later + f" FROM g{j})")
    shares = [f"sum(y * q{j}) / sum(q{j} * q{j}) AS c{j}" for j in range(p)] + [f"sum(a{k} * q{j}) / sum(q{j} * q{j}) AS r{j}_{k}" for j in range(p) for k in range(j + 1, p)]
    back = [f"c{j}" + "".join(f" - r{j}_{k} * b{k}" for k in range(j + 1, p)) + f" AS b{j}" for j in reversed(range(p))]
    return (
        "zs AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _F) + f" FROM ft WHERE {t} IS NOT NULL), "
        f"z AS (SELECT ccn, {t} AS y, observed, {scaled} FROM ft CROSS JOIN zs), zd AS (SELECT * FROM z WHERE y IS NOT NULL), "
        "q AS (SELECT * FROM z WHERE " + " OR ".join(f"{c} IS NULL" for c in _F) + "), " + reg._knn_pairs_sql(_F, "q", "zd", _F)
        + f", it AS ({items}), rk0 AS (SELECT *, row_number() OVER (PARTITION BY qk, target ORDER BY dist, gk, dk) AS rn FROM it), "
        f"im AS (SELECT qk, target, avg(tv) AS v FROM rk0 WHERE rn <= {S.KNN_IMPUTE_K} GROUP BY qk, target), "
        "mu AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}" for c in _F) + f" FROM zd), zi AS (SELECT z.ccn, z.y, z.observed, {filled} FROM z CROSS JOIN mu), "
        + ", ".join(steps) + f", rr AS (SELECT {', '.join(shares)} FROM g{p - 1}), bb AS (SELECT {', '.join(back)} FROM rr), "
        "ym AS (SELECT avg(y) AS y, " + ", ".join(f"avg({c}) AS {c}" for c in _F) + " FROM zi WHERE y IS NOT NULL), "
        "coef AS (SELECT bb.*, y" + "".join(f" - b{i} * {c}" for i, c in enumerate(_F)) + " AS b0_ FROM bb CROSS JOIN ym)"
    )


def _contribution_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT ccn, '{c}' AS feature, '{S.INSIGHT_LABELS[c]}' AS label, {c if c in S.INSIGHT_UNSCALED else f'{c} * s_{c} + m_{c}'} AS your_score, "
        f"(SELECT avg({c}) FROM ft) AS mean_score, b{i} AS coefficient, CAST({c} AS DOUBLE) AS z FROM zi CROSS JOIN zs CROSS JOIN coef WHERE observed"
        for i, c in enumerate(_F)
    )
    return f"cc AS (SELECT *, coefficient * z AS contribution FROM ({cells}))"


def _for_targets_sql(select, more: str = "") -> str:
    one = [f"SELECT * FROM (WITH {_model_sql(t)}{more} {select(t)})" for t in S.INSIGHT_TARGETS]
    ft = f"ft AS (SELECT ccn, {', '.join([*_F, *map(reg.Q.q, S.INSIGHT_TARGETS)])}, {S.OBSERVED_COLUMN} IS NOT NULL AS observed FROM f1)"
    return reg._merged_sql(" UNION ALL ".join(one), reg._FEAT_CTES + ",\n" + ft)


def _insight_sql(target: str) -> str:
    rows = [("intercept", "intercept", "b0_")] + [(c, S.INSIGHT_LABELS[c], f"b{i}") for i, c in enumerate(_F)]
    return " UNION ALL ".join(f"SELECT '{target}' AS target, '{c}' AS feature, '{label}' AS label, {reg.R(b)} AS coefficient FROM coef" for c, label, b in rows)


def _contributions_sql(target: str) -> str:
    return f"SELECT '{target}' AS target, ccn, feature, label, " + ", ".join(f"{reg.R(c)} AS {c}" for c in ("your_score", "mean_score", "coefficient", "z", "contribution")) + " FROM cc"


def _recommendations_sql(target: str) -> str:
    best = reg._TB_SELECT.format(e="tb.ccn", extra=f", {reg.R('pd2.predicted')} AS predicted, {reg.R('pd2.actual')} AS actual").replace("SELECT ", f"SELECT '{target}' AS target, ", 1)
    return best.replace(" FROM tb", " FROM tb LEFT JOIN pd2 ON tb.ccn = pd2.ccn")


_PREDICTED_SQL = (
    ", ac AS (SELECT * FROM cc WHERE feature IN (" + ", ".join(f"'{c}'" for c in S.ACTIONABLE_FEATURES) + ")), " + reg._top_bottom_sql("ac", "ccn", "label", "contribution")
    + ", pd2 AS (SELECT ccn, round_even(b0_" + "".join(f" + b{i} * {c}" for i, c in enumerate(_F)) + ", 2) AS predicted, round_even(y, 2) AS actual FROM zi CROSS JOIN coef)"
)


@reg.register("train_insight_features", _for_targets_sql(_insight_sql))
def q_train_insight_features(spark, sf_dir):
    """P6 -> P7, K2: coefficients of both targets' saved pipelines on the feature table."""
    return _for_targets(_insight, spark, _table(spark, sf_dir))


@reg.register("contributions_features", _for_targets_sql(_contributions_sql, ", " + _contribution_sql()))
def q_contributions_features(spark, sf_dir):
    """K3, K5: each observed entity's un-scaled, imputed score and contribution by feature, for both targets."""
    return _for_targets(_contributions, spark, _table(spark, sf_dir))


@reg.register("recommendations_features", _for_targets_sql(_recommendations_sql, ", " + _contribution_sql() + _PREDICTED_SQL))
def q_recommendations_features(spark, sf_dir):
    """K4 over the ten actionable features, for both targets."""
    return _for_targets(_recommendations, spark, _table(spark, sf_dir))
