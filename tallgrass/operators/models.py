"""Tabular baselines with pyspark.ml, cross-validated on declared folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.store import stored

#: Models that are fitted at a time.
_TOGETHER = 5


def baselines(n_features: int, seed: int = 42) -> dict:
    """The estimators by name. The kernel machine is linear here: there is no kernel SVM in pyspark.ml."""
    common = {"labelCol": "y", "featuresCol": "scaled"}
    return {
        "gradient_boosting": GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **common),
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed, **common),
        "elastic_net": LogisticRegression(elasticNetParam=0.5, regParam=0.01, **common),
        "linear_svm": LinearSVC(regParam=0.01, **common),
        "mlp": MultilayerPerceptronClassifier(layers=[n_features, 32, 16, 2], seed=seed, maxIter=60, **common),
    }


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows)


def cross_validated(rows: DataFrame, columns: list[str], names: list[str], n_folds: int, key: str, seed: int = 42) -> DataFrame:
    """(key, fold, method, y, score) on held-out folds; the scaler is fitted on the training folds only. ``rows`` has fold and y. ``_TOGETHER`` models are fitted at a time,
    as one leaves cores idle between its many short jobs; scores are stored, so metrics that read them several times do not score again."""
    vectors, jobs = stored(assembled(rows, columns).select(key, "fold", F.col("y").cast("double").alias("y"), "features"), "assembled"), []
    for fold in range(n_folds):
        train, test = vectors.where(F.col("fold") != fold), vectors.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
        train, test = scaler.transform(train), scaler.transform(test)
        jobs += [(name, estimator, train, test) for name, estimator in baselines(len(columns), seed).items() if name in names]

    def score(job: tuple) -> DataFrame:
        name, estimator, train, test = job
        scored = estimator.fit(train).transform(test)
        score = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return scored.select(key, "fold", F.lit(name).alias("method"), F.col("y").cast("int").alias("y"), score.alias("score"))

    with ThreadPoolExecutor(_TOGETHER) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(score), jobs))
    return stored(reduce(DataFrame.union, parts), "cross-validated")


def transferred(train: DataFrame, test: DataFrame, columns: list[str], name: str, key: str, seed: int = 42) -> DataFrame:
    """(key, y, score) of another cohort, everything fitted on the first."""
    train, test = assembled(train, columns), assembled(test, columns)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    scored = baselines(len(columns), seed)[name].fit(scaler.transform(train)).transform(scaler.transform(test))
    return scored.select(key, F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def latent(rows: DataFrame, columns: list[str], k: int, key: str) -> DataFrame:
    """(key, latent): principal components as the latent space."""
    vectors = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(assembled(rows, columns)).transform(assembled(rows, columns))
    return PCA(k=k, inputCol="scaled", outputCol="pc").fit(vectors).transform(vectors).select(key, vector_to_array("pc").alias("latent"))


def residualised(rows: DataFrame, y: str, covariates: list[str], out: str = "residual") -> DataFrame:
    """y less its linear fit on any number of covariates."""
    vectors = VectorAssembler(inputCols=covariates, outputCol="_x").transform(rows)
    fitted = LinearRegression(featuresCol="_x", labelCol=y, predictionCol="_fit", solver="normal").fit(vectors).transform(vectors)
    return fitted.withColumn(out, F.col(y) - F.col("_fit")).drop("_x", "_fit")
