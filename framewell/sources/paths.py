"""Checks of inputs and outputs before a tool runs, through Spark's file systems."""

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    """The path in full, as its file system names it, and that file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.exists(p)


def same(spark: SparkSession, one: str, two: str) -> bool:
    """Whether two names mean one path."""
    return _file(spark, one)[0].toString() == _file(spark, two)[0].toString()


def check(spark: SparkSession, inputs: list[str], output: str | None = None, overwrite: bool = False) -> None:
    """Raise unless every input is there and the output is none of them, nor there already unless overwritten."""
    for path in inputs:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    if output is None:
        return
    if any(same(spark, path, output) for path in inputs):
        raise ValueError(f"the output is an input: {output}")
    if not overwrite and exists(spark, output):
        raise FileExistsError(output)
