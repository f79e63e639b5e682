"""Boosted trees on samples, and scoring with any fitted model."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gaugeline.functions import binary_label, finite


def feature_vectors(samples: DataFrame, *, fill: float = 0.0, features: str = "features") -> DataFrame:
    """Feature array to a vector. MLlib trees take no missing values, so a missing cell becomes
    ``fill`` and a second half of the vector flags it."""
    filled = F.transform(features, lambda v: F.coalesce(v, F.lit(fill)))
    flags = F.transform(features, lambda v: v.isNull().cast("double"))
    return samples.withColumn("vector", array_to_vector(F.concat(filled, flags)))


def _labelled(samples: DataFrame, label) -> DataFrame:
    # the booster is trained on the first output of a sample
    return feature_vectors(samples).withColumn("label", label(F.get("target", F.lit(0))).cast("double")).where(
        finite(F.col("label"))
    )


@dataclass(frozen=True)
class Training:
    """A boosted model cut to its best round, and the loss of every round up to where training ended, as
    ``(part, round, loss)`` with the parts ``train`` and ``test``."""

    model: PipelineModel
    best_round: int
    curve: list[tuple[str, int, float]]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The curve, a row per part and round, with ``best`` at the round the model was cut to."""
        rows = spark.createDataFrame(self.curve, "part string, round int, loss double")
        return rows.withColumn("best", F.col("round") == self.best_round)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of the least loss, the first of equals, and whether ``patience`` rounds without a
    lower loss follow it; what comes after those rounds is not looked at."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model, rounds: int):
    """A boosted model of the first trees of another."""
    if rounds >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    held, weight = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = held[i], weight[i]
    classes = isinstance(model, GBTClassificationModel)
    sizes = (model.numFeatures, model.numClasses) if classes else (model.numFeatures,)
    made = getattr(gateway.jvm, java.getClass().getName())(java.uid(), trees, weights, *sizes)
    return model._copyValues(type(model)(made))


def _losses(trees, data: DataFrame) -> list[float]:
    """Root mean square error or log loss after each round: one pass that adds up the trees row by row."""
    if isinstance(trees, GBTClassificationModel):
        return [x / 2 for x in trees.evaluateEachIteration(data)]  # the library's log loss is doubled
    return [math.sqrt(x) for x in trees.evaluateEachIteration(data, "squared")]


def _boosted(estimator, train: DataFrame, test: DataFrame | None, label, patience: int) -> Training:
    """All rounds without a test part.  With one, as many rounds as it takes until its loss has not fallen
    for ``patience`` of them: training starts again with twice the rounds until they suffice.  Equal seeds give
    equal first trees, so this ends at the round where going on tree by tree would."""
    data = _labelled(train, label).select("vector", "label")
    parts = {"train": data}
    if test is not None:
        parts["test"] = _labelled(test, label).select("vector", "label")
    most = estimator.getMaxIter()
    rounds = most if test is None or parts["test"].isEmpty() else min(most, 2 * patience)
    while True:
        trees = estimator.copy({estimator.maxIter: rounds}).fit(data)
        losses = {part: _losses(trees, rows) for part, rows in parts.items()}
        best, ended = (rounds, True) if test is None else best_round(losses["test"], patience)
        if ended or rounds == most:
            break
        rounds = min(most, 2 * rounds)
    end = min(rounds, best + patience) if test is not None else rounds
    curve = [(part, i + 1, float(x)) for part, found in losses.items() for i, x in enumerate(found[:end])]
    return Training(PipelineModel([first_rounds(trees, best)]), best, curve)


def train_regressor(
    train: DataFrame,
    test: DataFrame | None = None,
    *,
    rounds: int = 1100,
    depth: int = 5,
    subsample: float = 0.2,
    feature_share: float = 0.8,
    rate: float = 0.01,
    patience: int = 10,
    seed: int = 35,
) -> Training:
    """Boosted regression trees; with ``test`` training ends when its loss has not fallen for ``patience`` rounds."""
    gbt = GBTRegressor(
        featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, subsamplingRate=subsample,
        featureSubsetStrategy=str(feature_share), stepSize=rate, seed=seed,
    )
    return _boosted(gbt, train, test, lambda y: y, patience)


def train_classifier(
    train: DataFrame,
    test: DataFrame | None = None,
    *,
    rounds: int = 1500,
    depth: int = 10,
    subsample: float = 0.2,
    feature_share: float = 0.8,
    rate: float = 0.01,
    patience: int = 10,
    seed: int = 35,
) -> Training:
    """Boosted classification trees on labels rounded to 0 or 1."""
    gbt = GBTClassifier(
        featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, subsamplingRate=subsample,
        featureSubsetStrategy=str(feature_share), stepSize=rate, seed=seed,
    )
    return _boosted(gbt, train, test, binary_label, patience)


def fit_regressor(train: DataFrame, test: DataFrame | None = None, **options) -> PipelineModel:
    """The model of ``train_regressor``."""
    return train_regressor(train, test, **options).model


def fit_classifier(train: DataFrame, test: DataFrame | None = None, **options) -> PipelineModel:
    """The model of ``train_classifier``."""
    return train_classifier(train, test, **options).model


def loss_per_round(model: PipelineModel, samples: DataFrame, *, classes: bool = False) -> list[float]:
    """Loss after each boosting round on the samples."""
    return _losses(model.stages[-1], _labelled(samples, binary_label if classes else (lambda y: y)))


def predict(model: PipelineModel, samples: DataFrame, *, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """``(keep…, pred, target)`` for the first output."""
    scored = model.transform(feature_vectors(samples))
    return scored.select(*keep, F.col("prediction").alias("pred"), F.get("target", F.lit(0)).alias("target"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: A stored model of this size is held by every Python worker; larger ones need a service of their own.
MOST_MODEL_BYTES = 512 << 20


def store_model(spark: SparkSession, data: bytes, path: str) -> None:
    """Write a model of any library, serialised, where all executors can read it."""
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"a stored model has at most {MOST_MODEL_BYTES} bytes")
    spark.createDataFrame([(bytearray(data),)], "model binary").write.mode("overwrite").parquet(path)


def stored_model(spark: SparkSession, path: str, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]]):
    """``make_predict`` for ``score_batches`` from a stored model.

    The bytes are sent to each executor once; ``load`` turns them into a function from features to
    predictions, once per Python worker.
    """
    rows = spark.read.parquet(path)
    size = rows.agg(F.sum(F.length("model"))).first()[0] or 0
    if not 0 < size <= MOST_MODEL_BYTES:
        raise ValueError(f"{path} holds {size} bytes, not one stored model")
    held = spark.sparkContext.broadcast(bytes(rows.first()["model"]))
    return lambda: load(held.value)


def score_batches(
    samples: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    size: int,
    keep: Sequence[str] = ("sample_id",),
    batch_size: int = 1024,
) -> DataFrame:
    """Score with any fitted model: ``(keep…, pred, target)``, both arrays.

    ``make_predict`` loads the model once per Python worker and returns a function from a matrix
    (samples x features, NaN for missing) to a matrix (samples x outputs). Samples with a prediction
    or target that is no finite number are dropped. ``size`` is the number of features.
    """
    run = predict_batch_udf(
        make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[size]]
    )
    dense = F.transform("features", lambda v: F.coalesce(v, F.lit(float("nan"))))
    scored = samples.withColumn("pred", run(dense))
    usable = ~F.exists("pred", lambda v: ~finite(v)) & ~F.exists("target", lambda v: ~finite(v))
    return scored.where(usable).select(*keep, "pred", "target")
