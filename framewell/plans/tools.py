"""The four tools as plans from frames to frames, marks or a model."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators import features, images, marks, mlp, repair, scoring
from framewell.sources import marked_file, model_file, paths
from framewell.sources.frames import concat_inputs, frame_count, parse_avi, read_videos, write_avi


def undistort(inputs: list[DataFrame], params: images.Undistort = images.Undistort()) -> DataFrame:
    """Inputs one after another, each frame rotated, scaled, undistorted, cropped, sharpened and resized.

    The output's size is that of the first input's first frame unless it is set.
    """
    first = inputs[0].where("data is not null").orderBy("fn").select("width", "height").first()
    if first is None:
        raise ValueError("the first input has no readable frame")
    if params.rotation not in (0, 90, 180, 270):
        raise ValueError(f"rotation must be 0, 90, 180 or 270, not {params.rotation}")
    w, h = params.output(first["width"], first["height"])
    frames = concat_inputs(inputs) if len(inputs) > 1 else inputs[0]
    return images.transform(frames, lambda image: images.process(image, params, w, h))


def mark(frames: DataFrame, keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The marks that a session of key strokes leaves on one video."""
    n = frame_count(frames).first()
    return marks.session(keys, n["n_frames"] if n else 0, known)


def interpolate(frames: DataFrame, marked: DataFrame) -> DataFrame:
    """Frames with bad runs replaced: video_id, out_fn, data, kind."""
    readable = frames.where("data is not null")
    videos = readable.groupBy("video_id").agg((F.max("fn") + 1).alias("n_frames"))
    return repair.repair(readable.select("video_id", "fn", "data"), marked, videos, "data", images.blend_images)


def train(frames: DataFrame, marked: DataFrame, model: mlp.Classifier | None = None, seed: int = 0) -> mlp.Classifier:
    """One pass over the blocks of the sampled frames; their order is frame, row, column.

    Only the sampled frames and the three before each are cut into blocks: the choice of frames comes
    before the history, by joining it to the few luminance planes it needs.
    """
    readable = frames.where("data is not null")
    videos = readable.groupBy("video_id").agg((F.max("fn") + 1).alias("n_frames"))
    chosen = scoring.trained_frames(scoring.sample(videos, readable, seed), videos)
    planes = features.planes(frames).join(chosen, ["video_id", "fn"], "left_semi")
    examples = marks.with_marks(features.blocks_of(planes), marked).withColumn("label", F.col("marked").cast("double"))
    return mlp.train(model or mlp.Model.init(seed=seed), examples, ["video_id", "fn", "by", "bx"])


def classify(frames: DataFrame, model: mlp.Classifier | None) -> DataFrame:
    """The frames with a positive block.  Without a model it raises: a random one says nothing."""
    if model is None:
        raise ValueError("a model is needed to classify")
    return scoring.classified(scoring.score_frames(frames, model))


def classify_files(spark: SparkSession, frames: DataFrame, model_path: str, marked_path: str, overwrite: bool = False) -> None:
    """classify() from a classifier file to a marked file, which is replaced only if that is asked for."""
    paths.check(spark, [model_path], marked_path, overwrite)
    marked_file.write(classify(frames, model_file.load(spark, model_path)), marked_path)


def undistort_files(spark: SparkSession, inputs: str, output: str, params: images.Undistort = images.Undistort(), decode=parse_avi, fps: float = 25.0, overwrite: bool = False) -> None:
    """undistort() from a comma-separated list of video files or folders to AVI files."""
    names = [x.strip() for x in inputs.split(",")]
    paths.check(spark, names, output, overwrite)
    write_avi(undistort([read_videos(spark, x, decode) for x in names], params), output, fps, overwrite=overwrite)
