"""Models on MLlib: boosted fair prices out of fold, learned ranking weights.

Deviations: MLlib's boosted trees take no missing values (a sentinel and an
indicator stand in), and have no quantile loss (bands come from conformal margins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import regression_metrics, with_fold

MISSING = -1.0


def _prepared(d: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    d = reduce(lambda x, c: x.withColumn(f"{c}_f", F.coalesce(F.col(c).cast("double"), F.lit(MISSING))).withColumn(f"{c}_m", F.col(c).isNull().cast("double")), numeric, d)
    return reduce(lambda x, c: x.withColumn(f"{c}_s", F.coalesce(F.col(c), F.lit("?"))), categories, d)


def _pipeline(numeric: list[str], categories: list[str], iterations: int) -> Pipeline:
    index = [StringIndexer(inputCol=f"{c}_s", outputCol=f"{c}_i", handleInvalid="keep") for c in categories]
    inputs = [f"{c}_f" for c in numeric] + [f"{c}_m" for c in numeric] + [f"{c}_i" for c in categories]
    return Pipeline(stages=[*index, VectorAssembler(inputCols=inputs, outputCol="features"), GBTRegressor(labelCol="log_y", featuresCol="features", predictionCol="log_pred", maxIter=iterations, stepSize=0.1, maxBins=64, seed=0)])


def oof_gbt(d: DataFrame, target: str, numeric: list[str], categories: list[str], folds: int = 5, iterations: int = 40, group=None) -> DataFrame:
    """d with fold and pred: each fold predicted by a model of the other folds, on the log of the target."""
    rows = _prepared(with_fold(d, group if group is not None else F.col(d.columns[0]), folds), numeric, categories).withColumn("log_y", F.log(target))
    parts = []
    for k in range(folds):
        model = _pipeline(numeric, categories, iterations).fit(rows.where(F.col("fold") != k))
        parts.append(model.transform(rows.where(F.col("fold") == k)).withColumn("pred", F.exp("log_pred")).select(*d.columns, "fold", "pred"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def leave_one_out(d: DataFrame, source: str, target: str, numeric: list[str], categories: list[str], iterations: int = 40) -> DataFrame:
    """(source, metrics): each source predicted by a model of the others. Sources are few by nature."""
    rows = _prepared(d, numeric, categories).withColumn("log_y", F.log(target))
    parts = []
    for r in rows.select(source).distinct().orderBy(source).collect():
        model = _pipeline(numeric, categories, iterations).fit(rows.where(F.col(source) != r[0]))
        scored = model.transform(rows.where(F.col(source) == r[0])).withColumn("pred", F.exp("log_pred"))
        parts.append(regression_metrics(scored, target, "pred").withColumn(source, F.lit(r[0])))
    return reduce(lambda a, b: a.unionByName(b), parts)


def learned_weights(votes: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, weight): non-negative logistic coefficients that sum to 1, even if none is positive."""
    n = votes.count()
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(votes)
    model = LogisticRegression(labelCol=label, featuresCol="features", regParam=1.0 / max(n, 1), standardization=False).fit(assembled)
    positive = [max(float(c), 0.0) for c in model.coefficients]
    total = sum(positive)
    weights = [c / total if total else 1.0 / len(features) for c in positive]
    return votes.sparkSession.createDataFrame([(f, round(w, 3)) for f, w in zip(features, weights, strict=True)], "feature string, weight double")


def publishes(votes: int, sessions: int, learned_ndcg: float, hand_ndcg: float, force: bool = False) -> bool:
    """Learned weights replace the hand-set ones only with enough votes and sessions, and a held-out win."""
    return force or (votes >= 200 and sessions >= 5 and learned_ndcg > hand_ndcg)
