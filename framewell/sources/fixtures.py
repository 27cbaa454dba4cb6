"""Stand-ins for videos over the test tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.scalars import clamp

KEYS = {"error": " ", "click": "x", "view": "n", "signup": "b", "purchase": "p"}
#: Literal sizes for block counts.
GEOMETRY = [(1920, 1080), (640, 480), (64, 48), (65, 49), (24, 24), (16, 16), (9, 9), (8, 8)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-pixel video: video_id, fn, msec, value, marked."""
    return events(spark, sf_dir).where("event_id is not null").select(F.lit("events").alias("video_id"), F.col("event_id").alias("fn"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("msec"), F.least(F.lit(255.0), F.col("value")).cast("int").alias("value"), (F.coalesce(F.col("event_type") == "error", F.lit(False))).alias("marked"))


def series_videos(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg((F.max("fn") + 1).alias("n_frames"))


def series_marks(frames: DataFrame) -> DataFrame:
    return frames.where("marked").select("video_id", "fn")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 block of luminances a frame: video_id, fn, block, label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.lit("vectors").alias("video_id"), F.col("vec_id").alias("fn"), F.col("embedding").alias("block"), (F.col("label") <= 1).cast("int").alias("label"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 24x24 video: video_id, fn, x, y, b, g, r."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = e.agg((F.floor(F.count("*") / 9) * 9).alias("_n"))
    e = e.crossJoin(F.broadcast(n)).where("vec_id < _n")  # one row
    k, i = F.col("vec_id") % 9, F.col("i")
    at = lambda c: clamp(F.get("embedding", (i + c) % 64).cast("double") * 400 + 128).cast("int")
    e = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return e.select(F.lit("image").alias("video_id"), F.floor(F.col("vec_id") / 9).alias("fn"), (8 * (k % 3) + i % 8).cast("int").alias("x"), (8 * F.floor(k / 3) + F.floor(i / 8)).cast("int").alias("y"), at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24x24 video with a frame a row."""
    two = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    row = F.sort_array(F.collect_list(F.struct("y", "x", F.concat(two("b"), two("g"), two("r")).alias("h"))))
    p = pixels(spark, sf_dir).groupBy("video_id", "fn").agg(row.alias("p"))
    return p.select("video_id", "fn", (F.col("fn") * 40.0).alias("msec"), F.lit(24).alias("width"), F.lit(24).alias("height"), F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))


def image_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = e.agg((F.floor(F.count("*") / 9) * 9).alias("_n"))
    return e.crossJoin(F.broadcast(n)).where("vec_id < _n and vec_id % 9 = 0 and label in (0, 1)").select(F.lit("image").alias("video_id"), F.floor(F.col("vec_id") / 9).alias("fn"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key strokes: video_id, seq, key."""
    key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv]), F.col("event_type")), F.lit("x"))
    return events(spark, sf_dir).select(F.lit("events").alias("video_id"), F.col("event_id").alias("seq"), key.alias("key"))
