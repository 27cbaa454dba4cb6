"""Block features: luminance, temporal history, tiling and the 257-value vector."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.functions.scalars import LUMA
from framewell.operators.ordered import CHUNK, history

BLOCK, DEPTH = 8, 4


def blocks_along(n: Column, block: int = BLOCK) -> Column:
    """Blocks on an axis of n pixels: the last whole one is left out when n is a multiple of the block."""
    return F.greatest(F.floor((n - 1) / block), F.lit(0)).cast("int")


def block_grid(videos: DataFrame, block: int = BLOCK) -> DataFrame:
    """videos(width, height, ...) with a row for each block: bx, by and its corner x, y."""
    nx, ny = blocks_along(F.col("width"), block), blocks_along(F.col("height"), block)
    rows = videos.withColumns({"_nx": nx, "_ny": ny}).where("_nx > 0 and _ny > 0").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_nx") * F.col("_ny") - 1)))
    bx, by = F.col("_t") % F.col("_nx"), F.floor(F.col("_t") / F.col("_nx")).cast("int")
    return rows.withColumns({"bx": bx, "by": by}).withColumns({"x": F.col("bx") * block, "y": F.col("by") * block}).drop("_nx", "_ny", "_t")


def vector(*parts: str) -> Column:
    """The blocks of the history, newest first, and the bias -1."""
    return F.concat(*[F.col(p) for p in parts], F.array(F.lit(-1.0).cast("float")))


def block_vectors(blocks: DataFrame, value: str = "block", chunk: int = CHUNK) -> DataFrame:
    """blocks(video_id, fn, block array<float>), one block a frame -> with the column features."""
    return history(blocks, "video_id", "fn", value, DEPTH, chunk).withColumn("features", vector("h0", "h1", "h2", "h3")).drop("h0", "h1", "h2", "h3")


@F.pandas_udf(T.BinaryType())
def luminance_plane(data: pd.Series) -> pd.Series:
    """The luminances of a frame's pixels as float32 bytes."""
    w = np.array(LUMA, np.float32)
    return data.map(lambda d: None if d is None else (np.frombuffer(d, np.uint8).reshape(-1, 3).astype(np.float32) @ w / np.float32(255)).astype(np.float32).tobytes())


def tile(planes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """planes (depth, height, width), newest first -> (blocks, depth * block * block + 1), row by row."""
    depth, h, w = planes.shape
    ny, nx = max((h - 1) // block, 0), max((w - 1) // block, 0)
    cut = planes[:, : ny * block, : nx * block].reshape(depth, ny, block, nx, block).transpose(1, 3, 0, 2, 4)
    return np.concatenate([cut.reshape(ny * nx, depth * block * block), np.full((ny * nx, 1), -1, np.float32)], axis=1)


def planes(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """frames -> readable frames with the luminance planes h0..h3; the pixels go before the shuffle."""
    light = frames.where("data is not null").select("video_id", "fn", "width", "height", luminance_plane("data").alias("luma"))
    return history(light, "video_id", "fn", "luma", DEPTH, chunk).drop("luma")


def blocks_of(with_planes: DataFrame) -> DataFrame:
    """planes() -> video_id, fn, by, bx, features; for training, on the frames that are trained on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                v = tile(np.stack([np.frombuffer(h, np.float32).reshape(r.height, r.width) for h in (r.h0, r.h1, r.h2, r.h3)]))
                nx = max((r.width - 1) // BLOCK, 1)
                at = np.arange(len(v))
                yield pd.DataFrame({"video_id": r.video_id, "fn": r.fn, "by": at // nx, "bx": at % nx, "features": list(v)})

    return with_planes.select("video_id", "fn", "width", "height", "h0", "h1", "h2", "h3").mapInPandas(work, "video_id string, fn bigint, by int, bx int, features array<float>")
