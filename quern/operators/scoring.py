"""Scores: subsequences, candidates of a hidden name, a two-model ensemble."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def sequence_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two arrays over the longer length; 0 where one is empty, null for null. Counts don't wrap."""
    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) / max(len(x), len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b)], dtype="float64")


def gaussian(x: Column, mean: Column, deviation: Column) -> Column:
    """Density; with no deviation 1 at the mean and 0 elsewhere."""
    z = (x - mean) / deviation
    return F.when(deviation > 0, F.exp(-z * z / 2) / (deviation * math.sqrt(2 * math.pi))).otherwise(F.when(x == mean, 1.0).otherwise(0.0))


def candidate_scores(names: DataFrame, model: dict[str, float], known: str) -> DataFrame:
    """name, score: 0.4 for the length under the prediction, 0.3 for the width by
    letter, 0.2 for the share of distinct letters, 0.1 for the known letters it has."""
    n = F.char_length("name").cast("double")
    distinct = F.size(F.array_distinct(F.filter(F.split("name", ""), lambda c: c != "")))
    density = F.when(n > 0, F.lit(model["width"]) / n)
    have = sum((F.contains(F.lower("name"), F.lit(c)).cast("int") for c in sorted(set(known.lower()))), F.lit(0)) / max(len(set(known)), 1)
    score = (
        0.4 * gaussian(n, F.lit(model["length"]), F.lit(model["length_dev"]))
        + 0.3 * F.coalesce(gaussian(density, F.lit(model["density"]), F.lit(model["density_dev"])), F.lit(0.0))
        + 0.2 * F.coalesce(gaussian(distinct / n, F.lit(model["variety"]), F.lit(model["variety_dev"])), F.lit(0.0))
        + 0.1 * have
    )
    return names.select("name", score.alias("score"))


def fit_ensemble(df: DataFrame, features: list[str], label: str, folds: int = 5, seed: int = 3):
    """A forest and boosted trees, weighted by their mean R² over the folds; a negative R² gets no weight.

    Returns a function that adds ``prediction`` and ``uncertainty`` (the population
    deviation over the forest's trees) to a table.
    """
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(df).withColumn("_fold", F.pmod(F.xxhash64(*features, label), F.lit(folds)))
    kinds = [RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="_p0", numTrees=100, minInstancesPerNode=2, seed=seed), GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_p1", maxIter=100, stepSize=0.1, seed=seed)]
    weights = []
    for i, kind in enumerate(kinds):
        r2 = RegressionEvaluator(labelCol=label, predictionCol=f"_p{i}", metricName="r2")
        scores = []
        for fold in range(folds):
            test, rest = data.where(F.col("_fold") == fold), data.where(F.col("_fold") != fold)
            if test.count() > 1 and not rest.isEmpty():
                scores.append(r2.evaluate(kind.fit(rest).transform(test)))
        weights.append(max(0.0, sum(scores) / len(scores)) if scores else 0.0)
    total = sum(weights)
    shares = [w / total for w in weights] if total > 0 else [0.5, 0.5]
    forest, boosted = (k.fit(data) for k in kinds)

    def predict(rows: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
        out = boosted.transform(forest.transform(out))
        trees = []
        for t, tree in enumerate(forest.trees):
            out = tree.setPredictionCol(f"_t{t}").transform(out)
            trees.append(F.col(f"_t{t}"))
        each = F.array(*trees)
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / len(trees)
        spread = F.sqrt(F.aggregate(each, F.lit(0.0), lambda s, x: s + F.pow(x - mean, 2)) / len(trees))
        return out.select(*rows.columns, (shares[0] * F.col("_p0") + shares[1] * F.col("_p1")).alias("prediction"), spread.alias("uncertainty"))

    return predict


def quality_class(matches: Column, inliers: Column, error: Column) -> Column:
    """A to D by matches, share of inliers and reprojection error (pixels); D is for manual work."""
    failed = (matches < 20) | (inliers < 0.15) | (error > 20)
    return F.when(failed, "D").when((matches >= 100) & (inliers >= 0.5) & (error <= 3), "A").when((matches >= 50) & (inliers >= 0.3) & (error <= 8), "B").otherwise("C")
