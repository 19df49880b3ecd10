"""A small image classifier, its scores, and array helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hidden units, classes, sides of a digit.
HIDDEN, CLASSES, SIDE = 128, 10, 28


def normalise_pixels(c: Column) -> Column:
    return F.transform(c, lambda x: x / F.lit(255.0))


def train_classifier(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 60, seed: int = 0) -> PipelineModel:
    """Layers d-HIDDEN-CLASSES, trained by Spark's own classifier (L-BFGS, sigmoid units): the same shape, another optimiser
    (network.train_network has the same one). A table without rows is an error."""
    rows = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("label"))
    first = rows.first()
    if first is None:
        raise ValueError("there are no rows to train on")
    size = len(first["raw"])
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    net = MultilayerPerceptronClassifier(layers=[size, HIDDEN, CLASSES], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[scale, net]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds digit and probabilities."""
    rows = model.transform(df.withColumn("raw", array_to_vector(F.col(features).cast("array<double>"))).withColumnRenamed(features, "_in"))
    rows = rows.withColumns({"digit": F.col("prediction").cast("long"), "probabilities": vector_to_array("probability")})
    return rows.drop("raw", "features", "rawPrediction", "probability", "prediction").withColumnRenamed("_in", features)


def evaluate(df: DataFrame, prediction: str = "digit", label: str = "label") -> DataFrame:
    """One row: correct, total, accuracy (0 without rows)."""
    correct = F.coalesce(F.sum((F.col(prediction) == F.col(label)).cast("long")), F.lit(0))
    rows = df.agg(correct.alias("correct"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def epoch_loss(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The training loss after each iteration."""
    history = model.stages[-1].summary().objectiveHistory
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(history)], "epoch int, loss double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _catmull_rom(n: int, m: int) -> np.ndarray:
    """Weights (m x n) of bicubic resizing with a = -0.5; shrinking widens the kernel."""
    scale = max(1.0, n / m)
    at = (np.arange(m) + 0.5) * n / m - 0.5
    x = np.abs((np.arange(n)[None, :] - at[:, None]) / scale)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def image_to_features(frames: DataFrame) -> DataFrame:
    """frames: keys, data (BGR), width, height. features: SIDE x SIDE grey values, 0 to 1."""
    keep = [c for c in frames.columns if c not in ("data", "width", "height")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, w, h in zip(pdf.data, pdf.width, pdf.height):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3).astype(float)
                grey = image @ np.array([0.114, 0.587, 0.299])
                out.append(np.clip(_catmull_rom(h, SIDE) @ grey @ _catmull_rom(w, SIDE).T / 255.0, 0, 1).ravel())
            yield pdf[keep].assign(features=out)

    kept = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in keep)
    return frames.mapInPandas(run, f"{kept}features array<double>")


def add_vectors(a: Column, b: Column) -> Column:
    """Element by element; arrays of different lengths are an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("the arrays differ in length"))
    return F.when(same.isNull(), F.zip_with(a, b, lambda x, y: x + y))


def detector_size(width: Column, height: Column) -> Column:
    """The longer side, at least 32, rounded up to a multiple of 32."""
    return (F.ceil(F.greatest(width, height, F.lit(32)) / 32) * 32).cast("int")
