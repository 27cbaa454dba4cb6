"""Mark sets: joins with frames, toggling, and the marking session as a fold over keys."""

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.operators.ordered import CHUNK, nearest

ON = ["video_id", "fn"]


def within(marks: DataFrame, videos: DataFrame) -> DataFrame:
    """Marks from 0 to the video's frame count; others are dropped, and duplicates count once."""
    return marks.join(videos.select("video_id", "n_frames"), "video_id").where("fn >= 0 and fn < n_frames").select(*ON).distinct()


def with_marks(frames: DataFrame, marks: DataFrame, name: str = "marked") -> DataFrame:
    """frames with a boolean column: whether a mark is on the frame."""
    m = marks.select(*ON).distinct().withColumn("_m", F.lit(True))
    return frames.join(m, ON, "left").withColumn(name, F.coalesce("_m", F.lit(False))).drop("_m")


def marked_frames(frames: DataFrame, marks: DataFrame) -> DataFrame:
    return frames.join(marks, ON, "left_semi")


def unmarked_frames(frames: DataFrame, marks: DataFrame) -> DataFrame:
    return frames.join(marks, ON, "left_anti")


def nearest_marks(frames: DataFrame, marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """frames(video_id, fn, ...) with previous_marked and next_marked, both strict."""
    return nearest(with_marks(frames, marks, "_marked"), "video_id", "fn", F.col("_marked"), chunk).drop("_marked")


def toggled(toggles: DataFrame) -> DataFrame:
    """(video_id, fn) once per flip -> the frames that end marked: an odd number of flips."""
    return toggles.groupBy(*ON).agg(F.count("*").alias("flips")).where("flips % 2 = 1").select(*ON)


def session(keys: DataFrame, n_frames: int, marks: DataFrame | None = None) -> DataFrame:
    """A marking session: keys(video_id, seq, key) in order of seq -> the marks that it leaves.

    Space flips the mark under the cursor and advances; b and v go back one and five, not below 0; n
    and p jump to the next and previous mark, or stay; s goes to the start; q stops; any other key
    advances.  The session ends at the last frame.  A session is one person's key strokes for one
    video, a sequence by nature, so it is folded whole; the marks are a sorted list that each key
    searches by halves.
    """
    sent = keys.select("video_id", "seq", F.col("key"), F.lit(None).cast("bigint").alias("fn"))
    if marks is not None:
        sent = sent.unionByName(marks.select("video_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("key"), "fn"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        log = rows[rows["seq"].notna()].sort_values("seq")
        has = sorted({int(x) for x in rows["fn"].dropna()})
        fn = 0
        for key in log["key"]:
            if fn >= n_frames or key == "q":
                break
            at = bisect_left(has, fn)
            on = at < len(has) and has[at] == fn
            if key == "b":
                fn = max(fn - 1, 0)
            elif key == "v":
                fn = max(fn - 5, 0)
            elif key == "n":
                fn = has[at + on] if at + on < len(has) else fn
            elif key == "p":
                fn = has[at - 1] if at else fn
            elif key == "s":
                fn = 0
            else:
                if key == " ":
                    if on:
                        del has[at]
                    else:
                        has.insert(at, fn)
                fn += 1
        return pd.DataFrame({"video_id": rows["video_id"].iloc[0], "fn": pd.Series(has, dtype="int64")})

    return sent.groupBy("video_id").applyInPandas(fold, "video_id string, fn bigint")
