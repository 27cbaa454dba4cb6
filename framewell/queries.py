"""The registered queries of the frame operators, over the fixtures, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.cluster import shared_dir
from framewell.functions import scalars
from framewell.operators import features, images, marks, mlp, pixels, progress, repair, scoring
from framewell.plans import tools
from framewell.sources import fixtures, frames as frame_sources, marked_file, model_file

SMALL = (257, 16, 16, 1)


def repair_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.series(spark, sf_dir)
    return repair.repair(s.select("video_id", "fn", "value"), fixtures.series_marks(s), fixtures.series_videos(s)).select("out_fn", "value", "kind")


def mark_islands(spark, sf_dir):
    return repair.islands(fixtures.series_marks(fixtures.series(spark, sf_dir))).select("a", "b", (F.col("b") - F.col("a") + 1).alias("n_frames"))


def repair_segments(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    return repair.segments(fixtures.series_marks(s), fixtures.series_videos(s)).drop("video_id")


def nearest_marks(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    return marks.nearest_marks(s.select("video_id", "fn"), fixtures.series_marks(s)).drop("video_id")


def toggle_marks(spark, sf_dir):
    t = fixtures.events(spark, sf_dir).where("event_type = 'error'").select(F.lit("events").alias("video_id"), F.col("user_id").alias("fn"))
    return marks.toggled(t).select("fn")


def mark_join(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    return marks.with_marks(s.select("video_id", "fn", "value"), fixtures.series_marks(s)).drop("video_id")


def mark_semi(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    return marks.marked_frames(s, fixtures.series_marks(s)).select("fn", "value")


def mark_anti(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    return marks.unmarked_frames(s, fixtures.series_marks(s)).select("fn", "value")


def trained_frames(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    v = fixtures.series_videos(s)
    return scoring.trained_frames(scoring.sample(v, s), v).select("fn")


def timecode(spark, sf_dir):
    s = fixtures.series(spark, sf_dir).crossJoin(F.broadcast(fixtures.series(spark, sf_dir).agg(F.min("msec").alias("t0"))))
    return s.select("fn", scalars.timecode(F.col("msec") - F.col("t0")).alias("timecode"))


def fourcc(spark, sf_dir):
    codes = spark.createDataFrame([(1196444237,), (875967080,), (1145656920,), (0x34363248,)], "code int")
    return codes.select("code", scalars.fourcc(F.col("code")).alias("name"))


def input_concat(spark, sf_dir):
    s = fixtures.series(spark, sf_dir).select("video_id", "fn", "value")
    n = s.count() // 2
    return frame_sources.concat_inputs([s.where(F.col("fn") >= n).withColumn("fn", F.col("fn") - n), s.where(F.col("fn") < n)]).select("fn", "value")


def frame_counts(spark, sf_dir):
    s = fixtures.series(spark, sf_dir)
    data = s.select(F.concat_ws("-", F.lit("v"), F.col("value") % 7).alias("video_id"), "fn", F.when(~F.col("marked"), F.lit(1)).alias("data"))
    return frame_sources.frame_count(data)


def block_history(spark, sf_dir):
    v = features.block_vectors(fixtures.blocks(spark, sf_dir))
    at = lambda i: F.round(F.get("features", F.lit(i)).cast("double"), 4)
    return v.select("fn", F.size("features").alias("n"), at(0).alias("h0"), at(64).alias("h1"), at(128).alias("h2"), at(192).alias("h3"), at(255).alias("last"), at(256).alias("bias"))


def block_grid(spark, sf_dir):
    sizes = spark.createDataFrame(fixtures.GEOMETRY, "width int, height int")
    return features.block_grid(sizes).groupBy("width", "height").agg(F.count("*").alias("blocks"), F.max("x").alias("last_x"), F.max("y").alias("last_y"))


def luminance(spark, sf_dir):
    return fixtures.pixels(spark, sf_dir).select("fn", "x", "y", F.round(scalars.luminance(F.col("b"), F.col("g"), F.col("r")), 4).alias("luma"))


def _rotated(angle: int):
    def query(spark, sf_dir):
        return pixels.rotate(fixtures.pixels(spark, sf_dir), angle, 24, 24).drop("video_id")

    query.__name__ = f"rotate_{angle}"
    return query


def working_size(spark, sf_dir):
    sizes = spark.createDataFrame([(w, h, r) for w, h in fixtures.GEOMETRY for r in (0, 90, 180, 270)], "width int, height int, rotation int")
    w, h = pixels.working_size(F.col("width"), F.col("height"), F.lit(0.75), F.lit(0.5), F.col("rotation"))
    return sizes.select("width", "height", "rotation", w.alias("fw"), h.alias("fh"))


def undistort_lut(spark, sf_dir):
    return pixels.undistort_lut(spark, 64, 48, 0.5).select("x", "y", (F.round("ux", 4) + 0.0).alias("ux"), (F.round("uy", 4) + 0.0).alias("uy"))


def undistort_remap(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir)
    return pixels.remap(p, pixels.undistort_lut(spark, 24, 24, 0.5), 24, 24).drop("video_id")


def tone_curve(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir)
    return p.select("fn", "x", "y", *[scalars.tone(F.col(c) / 255, 1.2, -0.05, 0.8).alias(c) for c in "bgr"])


def aspect_crop(spark, sf_dir):
    return pixels.crop(fixtures.pixels(spark, sf_dir), pixels.crop_box(24, 24, 24, 16)).drop("video_id")


def pixel_lerp(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir).drop("video_id")
    after = p.select((F.col("fn") - 1).alias("fn"), "x", "y", *[F.col(c).alias(f"{c}2") for c in "bgr"])
    return p.join(after, ["fn", "x", "y"]).select("fn", "x", "y", *[scalars.lerp(F.col(c), F.col(f"{c}2"), F.lit(0.25)).alias(c) for c in "bgr"])


def _digest(frames: DataFrame) -> DataFrame:
    return frames.select("fn", "width", "height", F.md5("data").alias("md5"))


def _pixels(frames: DataFrame, *columns: str) -> DataFrame:
    """A row for each pixel of each frame: the columns, x, y, b, g, r."""
    at = lambda k: F.conv(F.substr("h", 6 * F.col("i") + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    p = frames.select(*columns, "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return p.select(*columns, (F.col("i") % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))


def unsharp(spark, sf_dir):
    return _pixels(images.transform(fixtures.frames(spark, sf_dir), images.unsharp), "fn")


def resize(spark, sf_dir):
    return _pixels(images.transform(fixtures.frames(spark, sf_dir), lambda x: images.resize(x, 40, 30)), "fn")


def undistort_frames(spark, sf_dir):
    return _digest(tools.undistort([fixtures.frames(spark, sf_dir)], images.Undistort(rotation=90, width=24, height=16, alpha=0.5)))


def interpolate_frames(spark, sf_dir):
    out = tools.interpolate(fixtures.frames(spark, sf_dir), fixtures.image_marks(spark, sf_dir))
    return _pixels(out.withColumns({"width": F.lit(24), "height": F.lit(24)}), "out_fn", "kind")


def preview(spark, sf_dir):
    return _pixels(images.preview(fixtures.frames(spark, sf_dir), fixtures.image_marks(spark, sf_dir)), "fn")


def avi_round_trip(spark, sf_dir):
    path = shared_dir(spark)
    frame_sources.write_avi(fixtures.frames(spark, sf_dir), path, part_bytes=2**24)
    return _pixels(frame_sources.read_avi(spark, path, joined=True), "fn")


def avi_metadata(spark, sf_dir):
    path = shared_dir(spark)
    frame_sources.write_avi(fixtures.frames(spark, sf_dir), path, part_bytes=2**24)
    return frame_sources.read_avi_metadata(spark, path, joined=True).drop("video_id")


def seek(spark, sf_dir):
    return frame_sources.seek(fixtures.series(spark, sf_dir), 500, 100).select("fn", "value")


def progress_log(spark, sf_dir):
    s = fixtures.series(spark, sf_dir).withColumn("data", F.when(~F.col("marked"), F.col("value")))
    passed, seen = progress.observed(s)
    passed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([progress.log(seen)], "frames bigint, unreadable bigint, first_fn bigint, last_fn bigint")


def input_list(spark, sf_dir):
    e = fixtures.events(spark, sf_dir).select("event_id", F.concat(F.lit("  "), "event_type", F.lit(" ,\t"), F.col("user_id").cast("string"), F.lit(" \n, ,")).alias("text"))
    return e.select("event_id", F.posexplode(scalars.input_list(F.col("text"))).alias("place", "name"))


def sigmoid_slope(spark, sf_dir):
    v = scalars.sigmoid(F.col("value") / 100 - 2, 0.5)
    return fixtures.events(spark, sf_dir).select("event_id", F.round(v, 6).alias("v"), F.round(scalars.sigmoid_slope(v), 6).alias("slope"))


def output_size(spark, sf_dir):
    rows = []
    for w, h in fixtures.GEOMETRY:
        for rotation in (0, 90, 180, 270):
            for width, height in ((0, 0), (320, 0), (0, 200), (320, 200)):
                rows.append((w, h, rotation, width, height, *images.Undistort(rotation=rotation, width=width, height=height).output(w, h)))
    return spark.createDataFrame(rows, "width int, height int, rotation int, set_width int, set_height int, out_width int, out_height int")


def _scores(spark, sf_dir):
    return mlp.score(features.block_vectors(fixtures.blocks(spark, sf_dir)), mlp.Model.patterned(SMALL, "float64"), dtype="float64")


def mlp_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("fn", F.round("output", 4).alias("output"))


def _frame_scores(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("video_id", F.floor(F.col("fn") / 9).alias("fn"), "output")
    mean = rows.agg(F.avg("output").alias("m"))
    # Outputs lie close together: their distance from the mean decides.
    return scoring.frame_scores(rows.crossJoin(F.broadcast(mean)).select("video_id", "fn", (F.col("output") - F.col("m") + 0.5).alias("output")))


def frame_scores(spark, sf_dir):
    return _frame_scores(spark, sf_dir).select("fn", "blocks", "positive", F.round("mean_output", 4).alias("mean_output"), F.round("fraction", 4).alias("fraction"), "percent")


def classified_marks(spark, sf_dir):
    return scoring.classified(_frame_scores(spark, sf_dir), 0.5).select("fn")


def mlp_train(spark, sf_dir):
    v = features.block_vectors(fixtures.blocks(spark, sf_dir)).withColumn("label", F.col("label").cast("double"))
    return mlp.train(mlp.Model.init(SMALL, seed=1), v, ["fn"]).table(spark)


def classify_frames(spark, sf_dir):
    return tools.classify(fixtures.frames(spark, sf_dir), _untrained()).select("fn")


def score_frames(spark, sf_dir):
    s = scoring.score_frames(fixtures.frames(spark, sf_dir), _untrained())
    return s.select("fn", "blocks", "positive", F.round("mean_output", 4).alias("mean_output"), F.round("fraction", 4).alias("fraction"), "percent")


def _untrained() -> mlp.Model:
    """Weights from a seed under which some blocks are positive and some aren't."""
    model = mlp.Model.init(SMALL, seed=3)
    model.weights[-1] -= model.weights[-1].mean()
    return model


def marking_session(spark, sf_dir):
    # A session is one person's, so the events are dealt to sessions of a hundred keys.
    k = fixtures.keys(spark, sf_dir).withColumn("video_id", F.floor(F.col("seq") / 100).cast("string"))
    return marks.session(k, 60)


def marked_file_round_trip(spark, sf_dir):
    path = shared_dir(spark)
    marked_file.write(fixtures.series_marks(fixtures.series(spark, sf_dir)), path)
    return marked_file.read(spark, path, "events", 2**62).select("fn")


def model_file_round_trip(spark, sf_dir):
    path = shared_dir(spark)
    model_file.save(mlp.Model.patterned((5, 4, 3, 2)), spark, path)
    return model_file.load(spark, path).table(spark).withColumn("w", F.round("w", 4))


def _stream(spark, sf_dir):
    """The series as a stream of files, with each video's length, which ends it."""
    batch = fixtures.series(spark, sf_dir)
    ahead = batch.withColumn("video_id", F.concat(F.lit("v"), F.floor(F.col("fn") / 500).cast("string"))).withColumn("fn", F.col("fn") % 500)
    ahead = ahead.join(ahead.groupBy("video_id").agg((F.max("fn") + 1).alias("n_frames")), "video_id")
    path = shared_dir(spark)
    ahead.select("video_id", "fn", "value", "n_frames", "marked").write.parquet(path)
    return spark.readStream.schema("video_id string, fn bigint, value int, n_frames bigint, marked boolean").parquet(path), path


def stream_history(spark, sf_dir):
    from framewell.streaming import stateful

    stream, path = _stream(spark, sf_dir)
    return stateful.drain(stateful.history(stream), f"{path}-run")


def stream_repair(spark, sf_dir):
    from framewell.streaming import stateful

    stream, path = _stream(spark, sf_dir)
    return stateful.drain(stateful.repair(stream), f"{path}-run")


def queries() -> dict:
    plain = (repair_series, mark_islands, repair_segments, nearest_marks, toggle_marks, mark_join, mark_semi, mark_anti, trained_frames, timecode, fourcc, input_concat, frame_counts, block_history, block_grid, luminance, working_size, undistort_lut, undistort_remap, tone_curve, aspect_crop, pixel_lerp, unsharp, resize, undistort_frames, interpolate_frames, preview, avi_round_trip, avi_metadata, seek, progress_log, input_list, sigmoid_slope, output_size, mlp_score, frame_scores, classified_marks, mlp_train, classify_frames, score_frames, marking_session, marked_file_round_trip, model_file_round_trip, stream_history, stream_repair)
    return {f.__name__: f for f in (*plain, *map(_rotated, (90, 180, 270)))}
