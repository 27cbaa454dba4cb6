"""From block scores to marks, and the choice of frames to train on."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.functions.scalars import percentage
from framewell.operators.features import planes, tile
from framewell.operators.mlp import Classifier

THRESHOLD = 0.5
SCORES = ["blocks", "positive", "mean_output"]


def frame_scores(blocks: DataFrame, output: str = "output") -> DataFrame:
    """(video_id, fn, output) a block -> video_id, fn, blocks, positive, mean_output, fraction, percent."""
    out = blocks.groupBy("video_id", "fn").agg(F.count("*").alias("blocks"), F.count_if((F.col(output) > THRESHOLD) & ~F.isnan(output)).alias("positive"), F.avg(output).alias("mean_output"))
    return with_fraction(out)


def with_fraction(scores: DataFrame) -> DataFrame:
    scores = scores.withColumn("fraction", F.try_divide("positive", "blocks"))
    return scores.withColumn("percent", percentage(F.col("fraction")))


def classified(scores: DataFrame, least: float = 0.0) -> DataFrame:
    """The frames whose positive fraction is above `least`; a frame without blocks is not marked."""
    return scores.where(F.coalesce(F.col("fraction") > least, F.lit(False))).select("video_id", "fn")


def score_frames(frames: DataFrame, model: Classifier) -> DataFrame:
    """frames -> frame_scores() without a row for each block: tiled, scored and counted in one pass."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                v = tile(np.stack([np.frombuffer(h, np.float32).reshape(r.height, r.width) for h in (r.h0, r.h1, r.h2, r.h3)]))
                o = np.concatenate([model.classify(v[i : i + 4096])[:, 0] for i in range(0, len(v), 4096)]) if len(v) else np.empty(0)
                rows.append((r.video_id, r.fn, len(o), int((o > THRESHOLD).sum()), float(o.astype(np.float64).mean()) if len(o) else None))
            yield pd.DataFrame(rows, columns=["video_id", "fn", *SCORES])

    return with_fraction(planes(frames).mapInPandas(work, "video_id string, fn bigint, blocks bigint, positive bigint, mean_output double"))


def sample(videos: DataFrame, frames: DataFrame, seed: int = 12345, share: float = 0.1) -> DataFrame:
    """A tenth of each video's frame numbers, truncated in single precision, without repeats: (video_id, s).

    Numbers in order of a hash; the least are taken.  A threshold that surely holds them is found by
    bisection of nothing more than counts, so no video is sorted in one task.
    """
    hashed = frames.select("video_id", "fn", F.pmod((F.col("fn") + seed) * 1103515245 + 12345, F.lit(2**31)).alias("h"))
    k = F.floor((F.col("n_frames").cast("float") * F.lit(share).cast("float")).cast("float")).cast("long")
    want = videos.select("video_id", k.alias("k"), "n_frames")
    # Hashes in 1024 buckets: whole buckets below the one that holds the k-th, and part of that one.
    bucket = F.floor(F.col("h") / 2**21)
    from pyspark.sql import Window

    counts = hashed.groupBy("video_id", bucket.alias("bucket")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("video_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = counts.withColumn("left", before).join(want, "video_id").where("left < k").select("video_id", "bucket", (F.col("k") - F.col("left")).alias("room"))
    kept = hashed.withColumn("bucket", bucket).join(room, ["video_id", "bucket"])
    place = F.row_number().over(Window.partitionBy("video_id", "bucket").orderBy("h", "fn"))
    return kept.withColumn("_n", place).where("_n <= room").select("video_id", F.col("fn").alias("s"))


def trained_frames(subset: DataFrame, videos: DataFrame, corrected: bool = False) -> DataFrame:
    """The frames that training uses: the one after each of the subset, where there is one."""
    fn = F.col("s") + (0 if corrected else 1)
    return subset.select("video_id", fn.alias("fn")).join(videos.select("video_id", "n_frames"), "video_id").where("fn < n_frames").select("video_id", "fn")
