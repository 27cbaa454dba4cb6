"""Image operators at pixel grain: rows (video_id, fn, x, y, b, g, r).

For small frames and for checking; operators/images.py has the same on whole frames.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.scalars import tone

FRAME = ["video_id", "fn"]
CHANNELS = ("b", "g", "r")


def rotate(pixels: DataFrame, angle: int, width: int, height: int) -> DataFrame:
    """Clockwise by 0, 90, 180 or 270 degrees; width and height are those of the input."""
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}
    if angle not in to:
        raise ValueError(f"rotation must be 0, 90, 180 or 270, not {angle}")
    new_x, new_y = to[angle]
    return pixels.select(*FRAME, new_x.cast("int").alias("x"), new_y.cast("int").alias("y"), *CHANNELS)


def working_size(cols: Column, rows: Column, xscale: Column, yscale: Column, rotation: Column, corrected: bool = False) -> tuple[Column, Column]:
    """Scaled size, truncated, in single precision.

    A quarter turn gives both sides the original height before they are scaled, as found; corrected=True swaps.
    """
    turned = rotation.isin(90, 270)
    w, h = F.when(turned, rows).otherwise(cols), F.when(turned, cols if corrected else rows).otherwise(rows)
    scaled = lambda n, s: (n.cast("float") * s.cast("float")).cast("int")
    return scaled(w, xscale), scaled(h, yscale)


def undistort_lut(spark: SparkSession, fw: int, fh: int, alpha: float = -1.0) -> DataFrame:
    """(x, y) -> ux, uy, the place in the source, null where there is none (as at the very centre).

    It depends on the size and alpha only, so it is worked out once and joined to every frame.
    """
    a = fw / fh
    t = spark.range(fw * fh).select((F.col("id") % fw).cast("int").alias("x"), F.floor(F.col("id") / fw).cast("int").alias("y"))
    dx, dy = F.col("x") / fw * a - a / 2, F.col("y") / fh - 0.5
    t = t.withColumns({"dx": dx, "dy": dy})
    t = t.withColumn("rd", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    t = t.withColumn("ru", F.try_divide(F.col("rd"), 1 - alpha * F.col("rd") * F.col("rd")))
    k = F.try_divide(F.col("ru"), F.col("rd"))
    return t.select("x", "y", ((F.col("dx") * k + a / 2) * fw / a).alias("ux"), ((F.col("dy") * k + 0.5) * fh).alias("uy"))


def taps(lut: DataFrame, fw: int, fh: int) -> DataFrame:
    """The four source pixels of each place that lies within a pixel of the image: x, y, ox, oy, tap, tx, ty."""
    sx, sy = F.col("ux").cast("long"), F.col("uy").cast("long")
    lut = lut.where("ux is not null and uy is not null and abs(ux) < 1e9 and abs(uy) < 1e9")
    lut = lut.select("x", "y", sx.alias("sx"), sy.alias("sy"), (F.col("ux") - F.floor("ux")).alias("ox"), (F.col("uy") - F.floor("uy")).alias("oy"))
    lut = lut.where((F.col("sx") >= -1) & (F.col("sx") < fw) & (F.col("sy") >= -1) & (F.col("sy") < fh))
    x0, x1 = F.greatest("sx", F.lit(0)), F.least(F.col("sx") + 1, F.lit(fw - 1))
    y0, y1 = F.greatest("sy", F.lit(0)), F.least(F.col("sy") + 1, F.lit(fh - 1))
    four = F.array(*[F.struct(F.lit(i).alias("tap"), tx.cast("int").alias("tx"), ty.cast("int").alias("ty")) for i, (tx, ty) in enumerate(((x0, y0), (x1, y0), (x0, y1), (x1, y1)))])
    return lut.select("x", "y", "ox", "oy", F.explode(four).alias("t")).select("x", "y", "ox", "oy", "t.*")


def remap(pixels: DataFrame, lut: DataFrame, fw: int, fh: int, gain: float = 1.0, bias: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """Undistort and tone: each pixel from its four source pixels, black where there are none.

    The table has one row for each pixel of a frame and no more, whatever the number of frames.
    """
    source = pixels.select(*FRAME, F.col("x").alias("tx"), F.col("y").alias("ty"), *CHANNELS)
    near = source.join(taps(lut, fw, fh), ["tx", "ty"])
    four = [F.max(F.when(F.col("tap") == i, F.col(c))).alias(f"{c}{i}") for c in CHANNELS for i in range(4)]
    near = near.groupBy(*FRAME, "x", "y", "ox", "oy").agg(*four)

    def value(c: str) -> Column:
        v = [F.col(f"{c}{i}") / 255 for i in range(4)]
        top = v[0] * (1 - F.col("ox")) + v[1] * F.col("ox")
        bottom = v[2] * (1 - F.col("ox")) + v[3] * F.col("ox")
        return tone(top * (1 - F.col("oy")) + bottom * F.col("oy"), gain, bias, gamma)

    found = near.select(*FRAME, "x", "y", *[value(c).alias(f"_{c}") for c in CHANNELS])
    out = pixels.select(*FRAME, "x", "y").join(found, [*FRAME, "x", "y"], "left")
    return out.select(*FRAME, "x", "y", *[F.coalesce(f"_{c}", F.lit(0)).alias(c) for c in CHANNELS])


def crop_box(fw: int, fh: int, out_w: int, out_h: int) -> tuple[int, int, int, int]:
    """(x0, y0, width, height) of the part with the output's aspect; raises if it doesn't fit."""
    aspect = out_w / out_h
    if out_w > out_h:
        w, h = fw, int(fw / aspect + 0.5)
    else:
        w, h = int(fh * aspect + 0.5), fh
    x0, y0 = int((fw - w) / 2), int((fh - h) / 2)
    if w > fw or h > fh or x0 < 0 or y0 < 0:
        raise ValueError(f"a {w}x{h} crop doesn't fit {fw}x{fh}")
    return x0, y0, w, h


def crop(pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    x0, y0, w, h = box
    kept = pixels.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    return kept.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
