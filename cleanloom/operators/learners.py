"""Whole-table models from MLlib, by name, with their grids."""

from __future__ import annotations

import random
from collections.abc import Sequence
from math import exp, log

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.param import Param
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.encode import feature_vector
from cleanloom.operators.linear import ALPHAS
from cleanloom.operators.trees import boost
from cleanloom.session import cut

FEATURES, LABEL, PREDICTION = "_features", "_label", "prediction"
# fixed values: grids of the classifiers; C is the inverse of the total penalty
C_VALUES = ALPHAS
TREE_DEPTHS = (10, 30)
MIN_SPLITS = (2, 10, 100)
FOREST_SIZES = (10, 100, 1000)
# MLlib trees stop at this depth
DEEPEST = 30
# rounds of the boosted stumps, and the most steps of the SVM, which stops by its tolerance
BOOST_ROUNDS = 50
SVM_STEPS = 1000
# boosted stumps between two cuts of the scored rows
STUMPS_AT_ONCE = 10


def estimator(name: str, seed: int = 0) -> Estimator:
    """M13. A model by name; unknown names are an error."""
    io = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
    makers = {
        "logistic_regression": lambda: LogisticRegression(**io),
        "decision_tree": lambda: DecisionTreeClassifier(maxDepth=DEEPEST, seed=seed, **io),
        "random_forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=DEEPEST, seed=seed, **io),
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian", **io),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=SVM_STEPS, featuresCol=FEATURES, labelCol=LABEL), **io),
        "rf_regressor": lambda: RandomForestRegressor(numTrees=100, maxDepth=DEEPEST, seed=seed, **io),
    }
    if name not in makers:
        raise ValueError(f"unknown model {name!r}; use one of {sorted([*makers, 'ada_boost', 'gbt_regressor'])}")
    return makers[name]()


def grid(name: str, model: Estimator, n_rows: int) -> list[dict[Param, object]]:
    """Parameter grid of a classifier, as far as MLlib has the parameter."""
    build = ParamGridBuilder()
    if name == "logistic_regression":
        # the mean loss of MLlib takes the penalty per row
        build.addGrid(model.regParam, [1 / (c * n_rows) for c in C_VALUES]).addGrid(model.elasticNetParam, [1.0, 0.0])
    elif name == "decision_tree":
        build.addGrid(model.impurity, ["gini", "entropy"]).addGrid(model.maxDepth, list(TREE_DEPTHS))
        build.addGrid(model.minInstancesPerNode, [max(1, m // 2) for m in MIN_SPLITS])
    elif name == "random_forest":
        build.addGrid(model.numTrees, list(FOREST_SIZES)).addGrid(model.featureSubsetStrategy, ["sqrt", "log2"])
        build.addGrid(model.maxDepth, list(TREE_DEPTHS))
    elif name == "svm":
        build.addGrid(model.getClassifier().regParam, [1 / (c * n_rows) for c in C_VALUES])
    return build.build()


def random_forest_trials(model: RandomForestRegressor, trials: int, seed: int = 0) -> list[dict[Param, object]]:
    """M4. Seeded random draws of the forest's size, depth and smallest split."""
    draw = random.Random(seed)
    return [
        {
            model.numTrees: draw.randint(100, 1000),
            model.maxDepth: min(DEEPEST, draw.randint(10, 100)),
            model.minInstancesPerNode: max(1, draw.randint(5, 20) // 2),
        }
        for _ in range(trials)
    ]


def shaped(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return feature_vector(df.withColumn(LABEL, F.col(label).cast("double")), features, FEATURES)


def predict(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    name: str,
    tuned: bool = False,
    trials: int = 20,
    seed: int = 0,
) -> DataFrame:
    """Fit on ``train`` and add ``prediction`` to ``test``. ``tuned`` searches the model's grid by 5-fold F1, or for
    the forest regressor ``trials`` random settings on a validation split."""
    if name == "gbt_regressor":
        both = train.withColumn(LABEL, F.lit(True)).unionByName(test.withColumn(LABEL, F.lit(False)))
        return boost(both, [], features, label, test.columns, F.col(LABEL), seed=seed).where(~F.col(LABEL)).select(*test.columns, PREDICTION)
    ready = shaped(train, features, label)
    if name == "ada_boost":
        return _ada_boost(ready, shaped(test, features, label), seed=seed).drop(FEATURES, LABEL)
    model = estimator(name, seed)
    if tuned and name == "rf_regressor":
        score = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="rmse")
        model = TrainValidationSplit(
            estimator=model, estimatorParamMaps=random_forest_trials(model, trials, seed), evaluator=score, seed=seed
        )
    elif tuned:
        score = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="f1")
        maps = grid(name, model, ready.count())
        model = CrossValidator(estimator=model, estimatorParamMaps=maps, evaluator=score, numFolds=5, seed=seed)
    out = model.fit(ready).transform(shaped(test, features, label))
    return out.select(*test.columns, PREDICTION)


def _ada_boost(train: DataFrame, test: DataFrame, rounds: int = BOOST_ROUNDS, seed: int = 0) -> DataFrame:
    """M11. Boosted one-split trees; the weight of wrongly predicted rows grows from round to round."""
    classes = train.select(LABEL).distinct().count()
    rows = train.withColumn("_weight", F.lit(1.0))
    stump = DecisionTreeClassifier(
        maxDepth=1, featuresCol=FEATURES, labelCol=LABEL, predictionCol="_vote", weightCol="_weight", seed=seed
    )
    scored = test.withColumn("_votes", F.array().cast("array<struct<label:double,weight:double>>"))
    for step in range(rounds):
        model = stump.fit(rows)
        voted = model.transform(rows).drop("rawPrediction", "probability")
        wrong = F.col("_vote") != F.col(LABEL)
        share = voted.agg(F.sum(F.when(wrong, F.col("_weight")).otherwise(0.0)) / F.sum("_weight")).first()[0]
        if share >= 1 - 1 / classes:
            break
        share = max(share, 1e-10)
        weight = log((1 - share) / share) + log(classes - 1)
        vote = F.array(F.struct(F.col("_vote").alias("label"), F.lit(weight).alias("weight")))
        scored = model.transform(scored).withColumn("_votes", F.concat("_votes", vote)).drop(
            "_vote", "rawPrediction", "probability"
        )
        if (step + 1) % STUMPS_AT_ONCE == 0:
            scored = cut(scored)
        if share <= 1e-10:
            break
        grown = voted.withColumn("_weight", F.when(wrong, F.col("_weight") * exp(weight)).otherwise(F.col("_weight")))
        rows = cut(grown.drop("_vote"))
    labels = F.array_sort(F.array_distinct(F.transform("_votes", lambda v: v["label"])))
    totals = F.transform(
        labels,
        lambda label: F.struct(
            F.aggregate(
                "_votes", F.lit(0.0), lambda s, v: s + F.when(v["label"] == label, v["weight"]).otherwise(0.0)
            ).alias("total"),
            (-label).alias("order"),
        ),
    )
    return scored.withColumn(PREDICTION, -F.array_max(totals)["order"]).drop("_votes")

