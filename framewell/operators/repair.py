"""Run repair: gaps and islands of marks, and linear blends in their place.

A run a..b of marked frames and the two frames after it become b - a + 2 blends of the frame before
the run and frame b + 2, so each run makes the video a frame shorter; the frame b + 2 is taken as it
is even if it is marked, and a run that begins at b + 3 blends from the bad frame a.  These are the
rules as found; where they leave a case undefined, the policies are:
a run at frame 0 blends from frame b + 2 at both ends; a run whose frame b + 2 doesn't exist holds
the frame before it (or itself, at frame 0), and an unmarked b + 1 passes.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.cluster import written
from framewell.functions.scalars import lerp
from framewell.operators.marks import within
from framewell.operators.ordered import CHUNK, chunked, nearest, running_count


def islands(marks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """marks(video_id, fn) -> maximal runs (video_id, a, b), chunk by chunk, then joined at the cuts."""
    marks = chunked(marks.select("video_id", "fn").distinct(), "fn", chunk)
    w = Window.partitionBy("video_id", "_chunk").orderBy("fn")
    parts = marks.withColumn("_run", F.col("fn") - F.row_number().over(w)).groupBy("video_id", "_chunk", "_run").agg(F.min("fn").alias("a"), F.max("fn").alias("b")).select("video_id", "a", "b")
    cut = (F.col("a") % chunk == 0) | (F.col("b") % chunk == chunk - 1)
    # Two runs of each chunk at most touch a cut; only those are joined, so a video is no window.
    w = Window.partitionBy("video_id").orderBy("a")
    ends = parts.where(cut).withColumn("_new", F.coalesce((F.col("a") != F.lag("b").over(w) + 1).cast("int"), F.lit(1)))
    ends = ends.withColumn("_run", F.sum("_new").over(w)).groupBy("video_id", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return parts.where(~cut).unionByName(ends.select("video_id", "a", "b"))


def segments(marks: DataFrame, videos: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """marks, videos(video_id, n_frames) -> what replaces what: video_id, st, b, prev, src, n, div.

    Marks out of range are dropped one by one before runs are made, so a run that goes beyond the last
    frame keeps its marks up to it.

    The cursor after a run is at b + 3 at most, so an island that begins beyond that doesn't depend on
    those before it.  Islands are folded in chains that such gaps end, not video by video; the chains
    that begin in one chunk of frames are folded one after another in one task.
    """
    runs = chunked(islands(within(marks, videos), chunk), "a", chunk)
    last = runs.groupBy("video_id", "_chunk").agg(F.max("b").alias("_last"))
    last = last.select("video_id", "_chunk", F.lag("_last").over(Window.partitionBy("video_id").orderBy("_chunk")).alias("_last"))
    before = F.coalesce(F.lag("b").over(Window.partitionBy("video_id", "_chunk").orderBy("a")), "_last")
    runs = runs.join(last, ["video_id", "_chunk"]).withColumn("_new", F.coalesce(F.col("a") > before + 3, F.lit(True))).drop("_chunk", "_last")
    runs = nearest(runs, "video_id", "a", F.col("_new"), chunk)
    chain = F.when(F.col("_new"), F.col("a")).otherwise(F.col("previous_marked"))
    runs = chunked(runs.select("video_id", "a", "b", chain.alias("chain")), "chain", chunk).join(videos.select("video_id", "n_frames"), "video_id")
    return runs.groupBy("video_id", "_chunk").applyInPandas(_fold, "video_id string, st bigint, b bigint, prev bigint, src bigint, n bigint, div bigint")


def _fold(runs: pd.DataFrame) -> pd.DataFrame:
    """The segments of whole chains of islands (a, b, chain) in order."""
    runs = runs.sort_values("a")
    n_frames, out = int(runs["n_frames"].iloc[0]), []
    at, cursor, last = None, 0, None
    for a, b, chain in zip(runs["a"].tolist(), runs["b"].tolist(), runs["chain"].tolist()):
        if chain != at:
            at, cursor, last = chain, 0, None
        if b < cursor:
            continue
        st = max(a, cursor)
        src = b + 2 if b + 2 < n_frames else None
        prev = last if last is not None and st == cursor else st - 1 if st > 0 else None
        out.append((st, b, prev, src, b - st + (1 if src is None else 2), None if src is None else b - st + 3))
        cursor, last = b + (1 if src is None else 3), st
    found = pd.DataFrame(out, columns=["st", "b", "prev", "src", "n", "div"]).astype("Int64")
    found.insert(0, "video_id", runs["video_id"].iloc[0])
    return found


def blends(segs: DataFrame, number: bool = True, chunk: int = CHUNK) -> DataFrame:
    """A row for each blended frame: video_id, st, i, prev, src, alpha and its place out_fn.

    src is null where a frame is held, and prev is then the frame to hold.
    """
    if number:
        segs = running_count(segs, "video_id", "st", F.col("src").isNotNull(), "_shorter", chunk)
        segs = segs.withColumn("_shorter", F.col("_shorter") - F.col("src").isNotNull().cast("long"))
    rows = segs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    ends = F.coalesce("prev", "src", F.col("st") + F.col("i"))
    alpha = F.coalesce(F.try_divide(F.col("i"), F.col("div")), F.lit(0.0))
    out = rows.select("video_id", "st", "i", ends.alias("prev"), "src", alpha.alias("alpha"), *([(F.col("st") + F.col("i") - F.col("_shorter")).alias("out_fn")] if number else []))
    return out


def passed(frames: DataFrame, segs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The frames that no segment takes, with their place out_fn: one less for each run before them."""
    taken = segs.select("video_id", F.explode(F.sequence("st", F.coalesce("src", "b"))).alias("fn"))
    flags = segs.where("src is not null").select("video_id", F.col("st").alias("fn"), F.lit(True).alias("_run"))
    all_rows = frames.select("video_id", "fn", F.lit(False).alias("_run")).unionByName(flags)
    shorter = running_count(all_rows, "video_id", "fn", F.col("_run"), "_shorter", chunk).where(~F.col("_run")).drop("_run")
    kept = shorter.join(taken, ["video_id", "fn"], "left_anti")
    return kept.select("video_id", "fn", (F.col("fn") - F.col("_shorter")).alias("out_fn"))


def repair(frames: DataFrame, marks: DataFrame, videos: DataFrame, value: str = "value", blend=None, chunk: int = CHUNK) -> DataFrame:
    """frames(video_id, fn, value), marks, videos(video_id, n_frames) -> video_id, out_fn, value, kind.

    kind is copy, blend or hold.  `blend(p, s, alpha)` makes the value of a blended frame from columns;
    for ints it is lerp(), for arrays of ints pass lerp_arrays, for images an Arrow function.
    """
    blend = blend or lerp
    segs = written(segments(marks, videos, chunk))  # read three times below
    b = blends(segs, chunk=chunk)
    ends = frames.select("video_id", "fn", F.col(value).alias("_v"))
    p = ends.select("video_id", F.col("fn").alias("prev"), F.col("_v").alias("_p"))
    s = ends.select("video_id", F.col("fn").alias("src"), F.col("_v").alias("_s"))
    made = b.join(p, ["video_id", "prev"], "left").join(s, ["video_id", "src"], "left")
    held = F.col("src").isNull()
    made = made.select("video_id", "out_fn", F.when(held, F.col("_p")).otherwise(blend(F.col("_p"), F.col("_s"), F.col("alpha"))).alias(value), F.when(held, "hold").otherwise("blend").alias("kind"))
    copied = passed(frames, segs, chunk).join(ends, ["video_id", "fn"]).select("video_id", "out_fn", F.col("_v").alias(value), F.lit("copy").alias("kind"))
    return made.unionByName(copied)


def lerp_arrays(p, s, alpha):
    """lerp() of each channel of two arrays."""
    return F.zip_with(p, s, lambda x, y: lerp(x, y, alpha))
