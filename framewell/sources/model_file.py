"""The classifier file: tag, layers, rates, counts and weights as text; and a lossless table."""

import numpy as np
from pyspark.sql import SparkSession

from framewell.operators.mlp import Model

#: Fixed value: the file's first word.
TAG = "nn"


def dumps(model: Model) -> str:
    """Numbers have six significant digits, as the file has them; use write_table for all of them."""
    number = lambda x: f"{float(x):.6g}"
    lines = [TAG, str(model.num_layers), number(model.learning_rate), number(model.beta), *map(str, model.layer_counts)]
    lines += [" ".join(map(number, w.ravel())) for w in model.weights]
    return "\n".join(lines) + "\n"


def loads(text: str, dtype=np.float32) -> Model:
    words = text.split()
    if not words or words[0] != TAG:
        raise ValueError("not a classifier file")
    n = int(words[1])
    if n < 3:
        raise ValueError("a model has three layers at least")
    counts = tuple(map(int, words[4 : 4 + n]))
    model, at = Model(counts, float(words[2]), float(words[3])), 4 + n
    for a, b in zip(counts, counts[1:]):
        part = words[at : at + a * b]
        if len(part) != a * b:
            raise ValueError("the classifier file ends early")
        model.weights.append(np.array(part, dtype).reshape(a, b))
        at += a * b
    return model


def save(model: Model, spark: SparkSession, path: str) -> None:
    """To any file system that Spark knows, as a folder with one part."""
    spark.createDataFrame([(dumps(model).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    """A file or folder; a missing one raises, and no model is made up in its place."""
    return loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_table(model: Model, spark: SparkSession, path: str) -> None:
    model.table(spark).write.mode("overwrite").parquet(path)
