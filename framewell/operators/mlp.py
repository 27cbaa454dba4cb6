"""Multi-layer perceptron: one sigmoid per neuron, no bias but the input's, online gradient steps."""

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPOLOGY = (257, 257, 257, 1)


class Classifier(Protocol):
    """What training and scoring ask of a classifier; Model is one, and others may take its place."""

    def step(self, x: np.ndarray, target: np.ndarray) -> None:
        """Learn one example: a feature vector and the outputs it should have."""

    def classify(self, x: np.ndarray) -> np.ndarray:
        """Outputs (a row for each row of x), the first of which is the score."""


@dataclass
class Model:
    layer_counts: tuple[int, ...] = TOPOLOGY
    learning_rate: float = 0.1
    beta: float = 1.0
    weights: list[np.ndarray] = field(default_factory=list)  # (from, to) each

    def __post_init__(self):
        if len(self.layer_counts) < 3:
            raise ValueError("a model has three layers at least")

    @property
    def dtype(self) -> np.dtype:
        return self.weights[0].dtype

    @property
    def num_layers(self) -> int:
        return len(self.layer_counts)

    def layer_size(self, layer: int) -> int:
        return self.layer_counts[layer]

    def get(self, layer: int, i: int, j: int) -> float:
        """A weight; 0 where there is none."""
        w = self.weights[layer]
        return float(w[i, j]) if 0 <= i < w.shape[0] and 0 <= j < w.shape[1] else 0.0

    def set(self, layer: int, i: int, j: int, value: float) -> None:
        w = self.weights[layer]
        if 0 <= i < w.shape[0] and 0 <= j < w.shape[1]:
            w[i, j] = value

    @classmethod
    def init(cls, layer_counts=TOPOLOGY, learning_rate: float = 0.1, beta: float = 1.0, seed: int = 0, dtype=np.float32) -> "Model":
        """Weights uniform in [-1, 1)."""
        rng = np.random.default_rng(seed)
        m = cls(tuple(layer_counts), learning_rate, beta)
        m.weights = [rng.uniform(-1, 1, (a, b)).astype(dtype) for a, b in zip(m.layer_counts, m.layer_counts[1:])]
        return m

    @classmethod
    def patterned(cls, layer_counts, dtype=np.float32) -> "Model":
        """Weights ((31 i + 17 j + 7 l) mod 201 - 100) / 1000, the same in any engine."""
        m = cls(tuple(layer_counts))
        m.weights = [(((31 * np.arange(a)[:, None] + 17 * np.arange(b) + 7 * layer) % 201 - 100) / 1000).astype(dtype) for layer, (a, b) in enumerate(zip(m.layer_counts, m.layer_counts[1:]))]
        return m

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        if x.shape[-1] != self.layer_counts[0]:
            raise ValueError(f"{x.shape[-1]} inputs for {self.layer_counts[0]}")
        out = [x]
        for w in self.weights:
            with np.errstate(over="ignore"):
                out.append(1 / (1 + np.exp(-self.beta * (out[-1] @ w))))
        return out

    def classify(self, x: np.ndarray) -> np.ndarray:
        return self.activations(x)[-1]

    def step(self, x: np.ndarray, target: np.ndarray) -> None:
        """One example: all errors by the weights as they are, then all updates."""
        a = self.activations(x)
        e = [(target - a[-1]) * a[-1] * (1 - a[-1])]
        for w, v in zip(self.weights[:0:-1], a[-2:0:-1]):
            e.insert(0, (w @ e[0]) * v * (1 - v))
        for w, v, d in zip(self.weights, a, e):
            w += np.asarray(self.learning_rate, w.dtype) * np.outer(v, d).astype(w.dtype)

    def table(self, spark: SparkSession) -> DataFrame:
        """weights(layer, i, j, w)."""
        parts = []
        for layer, w in enumerate(self.weights):
            i, j = np.indices(w.shape)
            parts.append(pd.DataFrame({"layer": layer, "i": i.ravel(), "j": j.ravel(), "w": w.ravel().astype(np.float64)}))
        return spark.createDataFrame(pd.concat(parts), "layer int, i int, j int, w double")


def score(df: DataFrame, model: Model, features: str = "features", name: str = "output", dtype=np.float32) -> DataFrame:
    """df with the first output of the network for each feature vector."""
    layers, beta, weights = model.layer_counts, model.beta, [w.astype(dtype) for w in model.weights]

    @F.pandas_udf("double")
    def output(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(layers, beta=beta, weights=weights)
        for v in batches:
            yield pd.Series(m.classify(np.stack(v.to_numpy()).astype(dtype))[:, 0].astype(np.float64) if len(v) else [], dtype="float64")

    return df.withColumn(name, output(F.col(features)))


def score_sql(features: Column, model: Model) -> Column:
    """The same as a column expression, for small networks only: each layer nests in the next."""
    a = features
    for w in model.weights:
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in w[:, j]]) for j in range(w.shape[1])])
        a = _layer_sql(a, rows, model.beta)
    return F.get(a, F.lit(0))


def _layer_sql(a: Column, rows: Column, beta: float) -> Column:
    dot = lambda row: F.aggregate(F.zip_with(a, row, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(rows, lambda row: 1 / (1 + F.exp(-beta * dot(row))))


def train(model: Classifier, examples: DataFrame, order: list[str], features: str = "features", label: str = "label") -> Classifier:
    """One pass of online steps in the given order, which is a sequence by nature.

    One task takes the examples, sorted with spilling, batch by batch, and returns the model; it is run
    again if its executor is lost.  The given model takes on what was learned.
    """
    start = cloudpickle.dumps(model)
    sent = examples.select(F.struct(*order).alias("at"), F.col(features).alias("x"), F.col(label).alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = cloudpickle.loads(start)
        kind = getattr(m, "dtype", np.float32)
        for b in batches:
            for x, t in zip(b["x"], b["t"]):
                m.step(np.asarray(x, kind), np.asarray([t], kind))
        yield pd.DataFrame({"model": [cloudpickle.dumps(m)]})

    learned = sent.repartition(1).sortWithinPartitions("at").select("x", "t").mapInPandas(work, "model binary").first()
    if learned:
        model.__dict__.update(cloudpickle.loads(bytes(learned["model"])).__dict__)
    return model
