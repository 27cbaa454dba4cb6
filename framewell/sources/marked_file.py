"""The marked-frame file: frame numbers as text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators.marks import within


def read(spark: SparkSession, path: str, video_id: str, n_frames: int | None = None) -> DataFrame:
    """(video_id, fn): numbers apart by white space; repeats count once, numbers out of range are dropped."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("w")).where("w <> ''")
    marks = words.select(F.lit(video_id).alias("video_id"), F.col("w").cast("bigint").alias("fn")).distinct()
    if n_frames is None:
        return marks
    return within(marks, spark.createDataFrame([(video_id, n_frames)], "video_id string, n_frames bigint"))


def write(marks: DataFrame, path: str) -> None:
    """One number a line, ascending, in one file; an existing one is replaced."""
    marks.select("fn").distinct().orderBy("fn").coalesce(1).select(F.col("fn").cast("string")).write.mode("overwrite").text(path)
