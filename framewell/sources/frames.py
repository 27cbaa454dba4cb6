"""Frames from image folders, AVI files, other video files by a given decoder, and tables; frames to tables and AVI files."""

import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators.images import FRAMES
from framewell.operators.ordered import running_count
from framewell.sources.paths import check

VIDEOS = "video_id string, fourcc int, width int, height int, fps double, format int, iso_speed int, declared_frames bigint"


def read_images(spark: SparkSession, path: str, video_id: str, fps: float = 25.0) -> DataFrame:
    """A folder of images; frame numbers follow the file names' order.

    Only names and numbers are ranked, in one task; pixels stay where they are.
    """
    from pyspark.sql import Window

    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    names = spark.read.format("binaryFile").load(path).select("path").withColumn("fn", F.row_number().over(Window.orderBy("path")) - 1)
    data = F.when((F.col("nChannels") == 3) & (F.col("height") > 0), F.col("data"))
    # The two sources write the slashes after a scheme differently.
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
    joined = images.join(names, plain("origin") == plain("path"))
    return joined.select(F.lit(video_id).alias("video_id"), F.col("fn").cast("bigint").alias("fn"), (F.col("fn") * 1000.0 / fps).alias("msec"), "width", "height", data.alias("data"))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(id, list type, start, end) of RIFF chunks, lists flattened."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + size, end)
        if name in (b"RIFF", b"LIST"):
            yield name, bytes(data[start : start + 4]), start + 4, stop
            yield from _chunks(data, start + 4, stop)
        else:
            yield name, b"", start, stop
        at = start + size + (size & 1)


def parse_avi(data: bytes) -> tuple[dict, list[bytes | None]]:
    """Header and frames (B, G, R by row from the top; None where unreadable) of uncompressed 24-bit AVI."""
    view = memoryview(data)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    head: dict = {}
    frames: list[bytes | None] = []
    for name, _, a, b in _chunks(view, 0, len(view)):
        if name == b"avih":
            micro, _, _, _, total = struct.unpack_from("<5I", view, a)
            head |= {"fps": 1e6 / micro if micro else 0.0, "declared_frames": total}
        elif name == b"strf" and "width" not in head:
            _, w, h, _, bits, compression = struct.unpack_from("<IiiHHI", view, a)
            if bits != 24 or compression != 0:
                raise ValueError("only uncompressed 24-bit AVI can be decoded here")
            head |= {"width": w, "height": abs(h), "fourcc": compression, "bottom_up": h > 0}
        elif name[2:] in (b"db", b"dc") and "width" in head:
            w, h = head["width"], head["height"]
            stride = (3 * w + 3) & ~3
            if b - a < stride * h:
                frames.append(None)
                continue
            rows = np.frombuffer(view[a : a + stride * h], np.uint8).reshape(h, stride)[:, : 3 * w]
            frames.append((rows[::-1] if head["bottom_up"] else rows).tobytes())
    return head, frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi_head(n: int, width: int, height: int, fps: float, movi: int) -> bytes:
    """All of an AVI file before its first frame; movi is the size of what follows."""
    group = lambda name, body: b"LIST" + struct.pack("<I", len(body) + 4) + name + body
    stride = (3 * width + 3) & ~3
    avih = struct.pack("<14I", int(1e6 / fps), 0, 0, 0, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"DIB ", 0, 0, 0, 0, 1000, int(fps * 1000), 0, n, 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, stride * height, 0, 0, 0, 0)
    hdrl = group(b"hdrl", _chunk(b"avih", avih) + group(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return b"RIFF" + struct.pack("<I", 4 + len(hdrl) + 12 + movi) + b"AVI " + hdrl + b"LIST" + struct.pack("<I", 4 + movi) + b"movi"


def _avi_frame(data: bytes, width: int, height: int) -> bytes:
    """One frame's chunk: rows from the bottom, each padded to four bytes."""
    rows = np.zeros((height, (3 * width + 3) & ~3), np.uint8)
    rows[:, : 3 * width] = np.frombuffer(data, np.uint8).reshape(height, 3 * width)
    return _chunk(b"00db", rows[::-1].tobytes())


def build_avi(frames: list[bytes], width: int, height: int, fps: float = 25.0) -> bytes:
    """An uncompressed AVI file of frames that are B, G, R by row."""
    body = b"".join(_avi_frame(f, width, height) for f in frames)
    return _avi_head(len(frames), width, height, fps, len(body)) + body


#: An empty chunk that readers skip; Spark's text writer ends each of its rows with it.
JUNK = "JUNK\0\0\0\0"


def write_avi(frames: DataFrame, path: str, fps: float = 25.0, part_bytes: int = 2**30, overwrite: bool = False) -> None:
    """Readable frames as uncompressed AVI files: video_id=.../part=.../ with one file each, in order of fn.

    A video is cut into parts of `part_bytes` at most, as the format's sizes have 32 bits; parts are written
    by separate tasks, frame by frame.  Only counts are gathered beforehand.  All frames of a video have one
    size; another raises.
    """
    check(frames.sparkSession, [], path, overwrite)
    readable = frames.where("data is not null").select(F.coalesce("video_id", F.lit("")).alias("video_id"), "fn", "width", "height", "data")
    one = 8 + F.col("height") * F.floor((3 * F.col("width") + 3) / 4) * 4
    one = (one + one % 2 + len(JUNK)).cast("bigint")
    sizes = readable.groupBy("video_id").agg(F.min("width").alias("w"), F.max("width").alias("w2"), F.min("height").alias("h"), F.max("height").alias("h2"))
    odd = sizes.where("w <> w2 or h <> h2").select("video_id").first()
    if odd:
        raise ValueError(f"frames of several sizes in {odd[0]!r}")
    parts = running_count(readable, "video_id", "fn", F.lit(True), "nth").withColumns({"one": one, "part": F.floor((F.col("nth") - 1) / F.greatest(F.floor(part_bytes / one), F.lit(1))).cast("int")})
    heads = parts.groupBy("video_id", "part", "width", "height", "one").agg(F.count("*").alias("n"), F.min("fn").alias("fn")).withColumns({"kind": F.lit(0), "data": F.lit(None).cast("binary")})
    every = heads.unionByName(parts.drop("nth").withColumns({"kind": F.lit(1), "n": F.lit(None).cast("bigint")}))
    laid = every.repartition("video_id", "part").sortWithinPartitions("video_id", "part", "kind", "fn")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 16):
                c = b.iloc[i : i + 16]
                made = [_avi_head(int(r.n), r.width, r.height, fps, (int(r.n) * int(r.one)) + len(JUNK)) if r.kind == 0 else _avi_frame(r.data, r.width, r.height) for r in c.itertuples()]
                yield pd.DataFrame({"video_id": c["video_id"], "part": c["part"], "kind": c["kind"], "fn": c["fn"], "chunk": made})

    rows = laid.mapInPandas(work, "video_id string, part int, kind int, fn bigint, chunk binary")
    # The order is stated once more, as Spark doesn't know that Python keeps it.
    rows = rows.withColumn("video_id", F.coalesce("video_id", F.lit(""))).sortWithinPartitions("video_id", "part", "kind", "fn")
    out = rows.select("video_id", "part", F.col("chunk").cast("string").alias("value"))
    out.write.mode("overwrite").partitionBy("video_id", "part").option("lineSep", JUNK).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


Decoder = Callable[[bytes], tuple[dict, Iterable[bytes | None]]]


def read_videos(spark: SparkSession, path: str, decode: Decoder) -> DataFrame:
    """frames of video files; video_id is the path.

    decode(content) gives a head (width, height, fps) and the frames' B, G, R bytes, None where a frame is
    unreadable; any library that decodes compressed video can stand behind it.  Frames are taken one at a
    time, so a decoder that yields them holds one.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                head, found = decode(content)
                found, fn = iter(found), 0
                while held := list(islice(found, 16)):
                    n = range(fn, fn + len(held))
                    fn += len(held)
                    yield pd.DataFrame({"video_id": name, "fn": list(n), "msec": [k * 1000.0 / head["fps"] if head["fps"] else 0.0 for k in n], "width": head["width"], "height": head["height"], "data": held})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(work, FRAMES)


def read_avi(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """frames of uncompressed AVI files; video_id is the path.

    With `joined`, path is a folder of `write_avi`: video_id is what was written, and the frames of a video's
    parts are numbered one after another, unreadable ones included.
    """
    frames = read_videos(spark, path, parse_avi)
    if not joined:
        return frames
    from pyspark.sql import Window

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse_avi(x) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"].array, "video": b["video_id"].array, "part": b["part"].array, "n": [len(x) for _, x in found], "fps": [h["fps"] for h, _ in found]})

    parts = _parts(spark, path).mapInPandas(work, "path string, video string, part int, n bigint, fps double")
    before = F.sum("n").over(Window.partitionBy("video").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("path").alias("_path"), F.col("video").alias("_video"), "fps", F.coalesce(before, F.lit(0)).alias("_start"))  # a row for each file
    fn = F.col("fn") + F.col("_start")
    msec = F.when(F.col("fps") != 0, fn * 1000.0 / F.col("fps")).otherwise(0.0)
    return frames.join(F.broadcast(starts), F.col("video_id") == F.col("_path")).select(F.col("_video").alias("video_id"), fn.alias("fn"), msec.alias("msec"), "width", "height", "data")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """path, content, video_id and part of the files of `write_avi`; an empty id is a folder without a value."""
    schema = "path string, modificationTime timestamp, length bigint, content binary, video_id string, part int"
    return spark.read.format("binaryFile").schema(schema).load(path).select("path", "content", F.coalesce("video_id", F.lit("")).alias("video_id"), "part")


def read_avi_metadata(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """videos: a row of container metadata for each file; with `joined`, for each video of a folder of `write_avi`."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads = [parse_avi(x)[0] for x in b["content"]]
            yield pd.DataFrame({"video_id": b["path"].array, "fourcc": [x["fourcc"] for x in heads], "width": [x["width"] for x in heads], "height": [x["height"] for x in heads], "fps": [x["fps"] for x in heads], "format": 0, "iso_speed": 0, "declared_frames": [x["declared_frames"] for x in heads]})

    if not joined:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(work, VIDEOS)
    parts = _parts(spark, path).select(F.col("video_id").alias("path"), "content").mapInPandas(work, VIDEOS)
    alike = [c for c in parts.columns if c != "declared_frames"]
    return parts.groupBy(*alike).agg(F.sum("declared_frames").alias("declared_frames"))


def seek(frames: DataFrame, fn: int, n: int = 1, video_id: str | None = None) -> DataFrame:
    """The n frames from fn on, of one video or of each; the condition reaches the scan of a table."""
    found = frames.where((F.col("fn") >= fn) & (F.col("fn") < fn + n))
    return found if video_id is None else found.where(F.col("video_id") == video_id)


def frame_count(frames: DataFrame) -> DataFrame:
    """Readable frames of each video; a container's own count is only approximate."""
    return frames.where("data is not null").groupBy("video_id").agg(F.count("*").alias("n_frames"))


def concat_inputs(inputs: list[DataFrame], video_id: str = "joined", chunk: int | None = None) -> DataFrame:
    """Several inputs one after another, each after the last frame number of those before it."""
    from functools import reduce

    tagged = [f.withColumn("_input", F.lit(i)) for i, f in enumerate(inputs)]
    every = reduce(DataFrame.unionByName, tagged)
    size = every.groupBy("_input").agg((F.max("fn") + 1).alias("_n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.orderBy("_input").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = size.select("_input", before.alias("_start"))  # a row for each input
    return every.join(F.broadcast(starts), "_input").withColumns({"video_id": F.lit(video_id), "fn": F.col("fn") + F.col("_start")}).drop("_input", "_start")


def write_frames(frames: DataFrame, path: str) -> None:
    """Ordered frames as a table, a folder for each video."""
    frames.repartitionByRange("video_id", "fn").sortWithinPartitions("video_id", "fn").write.mode("overwrite").partitionBy("video_id").parquet(path)
