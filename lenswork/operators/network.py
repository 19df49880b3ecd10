"""The digit classifier as the reference trains it: a hidden layer of rectified units with dropout, mini-batches, Adam.

Training is data-parallel: in an epoch each of `parts` tasks goes through its share of the shuffled rows in
mini-batches, from the epoch's weights on, and Spark averages the tasks' weights and Adam's moments for the next one
(with one part this is plain mini-batch Adam). What travels is a few rows of weights for each task, never the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ml import CLASSES, HIDDEN

#: Share of hidden units that are dropped, and Adam's constants.
DROPOUT, RATE, BETA1, BETA2, TINY = 0.2, 1e-3, 0.9, 0.999, 1e-8
NAMES = ("w1", "b1", "w2", "b2")


@dataclass
class Network:
    """Weights by name, the mean of the batches' losses of each epoch, and Adam's moments and steps."""

    weights: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    steps: int = 0


def new_network(size: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 0) -> Network:
    """Uniform within 1 / sqrt(inputs) for each layer."""
    rng = np.random.default_rng(seed)
    shapes = {"w1": (size, hidden), "b1": (hidden,), "w2": (hidden, classes), "b2": (classes,)}
    inputs = {"w1": size, "b1": size, "w2": hidden, "b2": hidden}
    weights = {k: rng.uniform(-1, 1, s) / np.sqrt(inputs[k]) for k, s in shapes.items()}
    return Network(weights, moments={k: (np.zeros(s), np.zeros(s)) for k, s in shapes.items()})


def forward(weights: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hidden values and the classes' probabilities; mask: the factors of dropout."""
    hidden = np.maximum(x @ weights["w1"] + weights["b1"], 0)
    hidden = hidden if mask is None else hidden * mask
    z = hidden @ weights["w2"] + weights["b2"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return hidden, e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """The mean cross entropy of a batch and its gradient."""
    hidden, p = forward(weights, x, mask)
    n = len(y)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean()
    back = p
    back[np.arange(n), y] -= 1
    back /= n
    inner = back @ weights["w2"].T * (hidden > 0)
    inner = inner if mask is None else inner * mask
    return float(loss), {"w1": x.T @ inner, "b1": inner.sum(axis=0), "w2": hidden.T @ back, "b2": back.sum(axis=0)}


def adam_step(net: Network, gradient: dict[str, np.ndarray], rate: float = RATE) -> None:
    net.steps += 1
    for k in NAMES:
        m, v = net.moments[k]
        m, v = BETA1 * m + (1 - BETA1) * gradient[k], BETA2 * v + (1 - BETA2) * gradient[k] ** 2
        net.moments[k] = m, v
        net.weights[k] = net.weights[k] - rate * (m / (1 - BETA1**net.steps)) / (np.sqrt(v / (1 - BETA2**net.steps)) + TINY)


def _rows_of(net: Network) -> list[tuple]:
    return [(k, kind, x.ravel().tolist()) for k in NAMES for kind, x in (("weight", net.weights[k]), ("first", net.moments[k][0]), ("second", net.moments[k][1]))]


def train_network(df: DataFrame, features: str = "features", label: str = "label", epochs: int = 5, batch_size: int = 128, rate: float = RATE, hidden: int = HIDDEN, classes: int = CLASSES, dropout: float = DROPOUT, parts: int = 1, seed: int = 0) -> Network:
    """Trains on df's rows with features and a label in 0 to classes - 1; rows that lack either are left out.

    A table without such rows, features of several lengths and labels out of range are errors.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).filter("x is not null and y is not null")
    seen = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.min("y").alias("least"), F.max("y").alias("most")).first()
    if seen["low"] is None:
        raise ValueError("there are no rows to train on")
    if seen["low"] != seen["high"] or seen["least"] < 0 or seen["most"] >= classes:
        raise ValueError(f"features of {seen['low']} to {seen['high']} numbers, labels from {seen['least']} to {seen['most']}: one length and labels below {classes} are needed")
    net = new_network(seen["low"], hidden, classes, seed)
    shapes = {k: x.shape for k, x in net.weights.items()}
    context = df.sparkSession.sparkContext
    for epoch in range(epochs):
        sent = context.broadcast(net)
        order = F.xxhash64("x", "y", F.lit(seed * 1000 + epoch))  # another order and other shares in each epoch
        shares = rows.withColumn("_o", order).repartition(parts, F.pmod("_o", F.lit(1 << 20))).sortWithinPartitions("_o").drop("_o")

        def run(batches: Iterator[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            start = sent.value
            own = Network(dict(start.weights), moments=dict(start.moments), steps=start.steps)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            losses, seen = [], 0

            def learn(x: list, y: list) -> None:
                mask = (rng.random((len(y), hidden)) >= dropout) / (1 - dropout) if dropout else None
                loss, gradient = loss_and_gradient(own.weights, np.array(x), np.array(y), mask)
                adam_step(own, gradient, rate)
                losses.append(loss)

            x, y = [], []
            for pdf in batches:
                for a, b in zip(pdf.x, pdf.y):
                    x.append(a)
                    y.append(b)
                    if len(y) == batch_size:
                        learn(x, y)
                        seen += len(y)
                        x, y = [], []
            if y:
                learn(x, y)
                seen += len(y)
            if losses:
                yield pd.DataFrame(_rows_of(own), columns=["name", "kind", "numbers"]).assign(n=seen, loss=float(np.sum(losses)), batches=len(losses))

        made = shares.mapInPandas(run, "name string, kind string, numbers array<double>, n long, loss double, batches long").collect()  # a few rows for each part
        total = sum(r["n"] for r in made if r["name"] == "w1" and r["kind"] == "weight")
        mean = {(k, kind): sum(np.array(r["numbers"]) * (r["n"] / total) for r in made if (r["name"], r["kind"]) == (k, kind)).reshape(shapes[k]) for k in NAMES for kind in ("weight", "first", "second")}
        heads = [r for r in made if r["name"] == "w1" and r["kind"] == "weight"]
        net.weights = {k: mean[k, "weight"] for k in NAMES}
        net.moments = {k: (mean[k, "first"], mean[k, "second"]) for k in NAMES}
        net.steps += max(r["batches"] for r in heads)
        net.losses.append(sum(r["loss"] for r in heads) / sum(r["batches"] for r in heads))
        sent.destroy()
    return net


def predict_network(net: Network, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds digit and probabilities; null features give nulls."""
    sent = df.sparkSession.sparkContext.broadcast(net.weights)

    @F.pandas_udf("struct<digit:bigint,probabilities:array<double>>")
    def score(x: pd.Series) -> pd.DataFrame:
        there = x.notna().to_numpy()
        out = pd.DataFrame({"digit": pd.array([None] * len(x), "Int64"), "probabilities": [None] * len(x)})
        if there.any():
            _, p = forward(sent.value, np.array(x[there].tolist(), dtype=float))
            at = np.flatnonzero(there)
            out.loc[at, "digit"] = p.argmax(axis=1)
            for k, row in zip(at, p):
                out.at[k, "probabilities"] = row
        return out

    return df.withColumn("_found", score(F.col(features).cast("array<double>"))).select(*df.columns, "_found.digit", "_found.probabilities")


def epoch_losses(spark: SparkSession, net: Network) -> DataFrame:
    """Rows (epoch from 1, loss): the mean of the batches' losses."""
    return spark.createDataFrame([(k, x) for k, x in enumerate(net.losses, 1)], "epoch int, loss double")


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    rows = [(k, kind, list(net.weights[k].shape), numbers, net.steps, net.losses) for k, kind, numbers in _rows_of(net)]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, numbers array<double>, steps long, losses array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    rows = spark.read.parquet(path).collect()  # three rows for each of four arrays
    of = {(r["name"], r["kind"]): np.array(r["numbers"]).reshape(r["shape"]) for r in rows}
    return Network({k: of[k, "weight"] for k in NAMES}, list(rows[0]["losses"]), {k: (of[k, "first"], of[k, "second"]) for k in NAMES}, rows[0]["steps"])
