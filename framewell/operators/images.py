"""Image operators on whole frames: (video_id, fn, width, height, data), data B, G, R bytes by row.

numpy on Arrow batches; a frame is one value, so memory is a batch of frames.
"""

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = "video_id string, fn bigint, msec double, width int, height int, data binary"


def pixels_of(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def rotate(image: np.ndarray, angle: int) -> np.ndarray:
    if angle not in (0, 90, 180, 270):
        raise ValueError(f"rotation must be 0, 90, 180 or 270, not {angle}")
    return np.rot90(image, -(angle // 90))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with half-pixel centres, edges repeated, rounded."""
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image

    def along(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), (at - low).astype(np.float32)

    y0, y1, oy = along(h, height)
    x0, x1, ox = along(w, width)
    v = image.astype(np.float32)
    rows = v[y0] * (1 - oy)[:, None, None] + v[y1] * oy[:, None, None]
    out = rows[:, x0] * (1 - ox)[None, :, None] + rows[:, x1] * ox[None, :, None]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def blur(image: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    """Gaussian, 3 sigma to either side, mirrored at the edges without repeating them; float32."""
    r = int(round(sigma * 3))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k = (k / k.sum()).astype(np.float32)
    v = image.astype(np.float32)
    for axis in (0, 1):
        n = v.shape[axis]
        at = np.abs(np.arange(-r, n + r))
        period = max(2 * (n - 1), 1)
        at = at % period
        at = np.where(at >= n, period - at, at)
        wide = np.take(v, at, axis=axis)
        v = sum(k[i] * np.take(wide, np.arange(i, i + n), axis=axis) for i in range(2 * r + 1))
    return v


def unsharp(image: np.ndarray) -> np.ndarray:
    """1.5 times the image less half its blur, rounded and saturated at each step."""
    soft = np.clip(np.rint(blur(image)), 0, 255)
    return np.clip(np.rint(1.5 * image.astype(np.float32) - 0.5 * soft), 0, 255).astype(np.uint8)


@functools.lru_cache(maxsize=8)
def lut(fw: int, fh: int, alpha: float) -> tuple[np.ndarray, ...]:
    """For each pixel its source columns and rows (two each), weights and whether there is one."""
    f = np.float32
    with np.errstate(all="ignore"):
        a = f(fw) / f(fh)
        x, y = np.meshgrid(np.arange(fw, dtype=f), np.arange(fh, dtype=f))
        dx, dy = x / f(fw) * a - a / f(2), y / f(fh) - f(0.5)
        rd = np.sqrt(dx * dx + dy * dy)
        ru = rd / (f(1) - f(alpha) * rd * rd)
        ux, uy = (dx * ru / rd + a / f(2)) * f(fw) / a, (dy * ru / rd + f(0.5)) * f(fh)
    there = np.isfinite(ux) & np.isfinite(uy) & (np.abs(ux) < 1e9) & (np.abs(uy) < 1e9)
    ux, uy = np.where(there, ux, 0), np.where(there, uy, 0)
    sx, sy = np.trunc(ux).astype(np.int64), np.trunc(uy).astype(np.int64)
    there &= (sx >= -1) & (sx < fw) & (sy >= -1) & (sy < fh)
    clip = lambda v, n: np.clip(v, 0, n - 1)
    return clip(sx, fw), clip(np.minimum(sx + 1, fw - 1), fw), clip(sy, fh), clip(np.minimum(sy + 1, fh - 1), fh), (ux - np.floor(ux)).astype(f), (uy - np.floor(uy)).astype(f), there


def undistort(image: np.ndarray, alpha: float = -1.0, gain: float = 1.0, bias: float = 0.0, gamma: float = 1.0) -> np.ndarray:
    """Radial remap, bilinear gather and tone curve; black where there is no source."""
    h, w = image.shape[:2]
    x0, x1, y0, y1, ox, oy, there = lut(w, h, alpha)
    v = image.astype(np.float32) / np.float32(255)
    ox, oy = ox[:, :, None], oy[:, :, None]
    top = v[y0, x0] * (1 - ox) + v[y0, x1] * ox
    bottom = v[y1, x0] * (1 - ox) + v[y1, x1] * ox
    t = top * (1 - oy) + bottom * oy
    out = np.clip((np.power(t, np.float32(gamma)) * np.float32(gain) + np.float32(bias)) * 255, 0, 255)
    return np.where(there[:, :, None], out, 0).astype(np.uint8)


@dataclass(frozen=True)
class Undistort:
    """Settings of the undistort tool; None or 0 takes the first input's size, turned with a quarter turn."""

    rotation: int = 0
    width: int | None = None
    height: int | None = None
    alpha: float = -1.0
    xscale: float = 1.0
    yscale: float = 1.0
    gain: float = 1.0
    bias: float = 0.0
    gamma: float = 1.0
    corrected: bool = False

    def output(self, width: int, height: int) -> tuple[int, int]:
        if self.rotation in (90, 270):
            width, height = height, width
        return self.width or width, self.height or height


def process(image: np.ndarray, p: Undistort, out_w: int, out_h: int) -> np.ndarray:
    """Rotate, scale, undistort and tone, crop to the aspect, sharpen, resize, in this order."""
    from framewell.operators.pixels import crop_box

    h, w = image.shape[:2]
    if p.rotation in (90, 270):  # both sides are the original height, as found
        w, h = h, (w if p.corrected else h)
    fw, fh = int(np.float32(w) * np.float32(p.xscale)), int(np.float32(h) * np.float32(p.yscale))
    image = resize(rotate(image, p.rotation), fw, fh)
    image = undistort(image, p.alpha, p.gain, p.bias, p.gamma)
    x0, y0, cw, ch = crop_box(fw, fh, out_w, out_h)
    return resize(unsharp(image[y0 : y0 + ch, x0 : x0 + cw]), out_w, out_h)


def transform(frames: DataFrame, change) -> DataFrame:
    """frames with change(image) for each readable frame's image; unreadable frames are dropped."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 8):
                c = b.iloc[i : i + 8].copy()
                out = [change(pixels_of(d, w, h)) for d, w, h in zip(c["data"], c["width"], c["height"])]
                c["width"], c["height"] = [x.shape[1] for x in out], [x.shape[0] for x in out]
                c["data"] = [np.ascontiguousarray(x).tobytes() for x in out]
                yield c

    readable = frames.where("data is not null").select("video_id", "fn", "msec", "width", "height", "data")
    return readable.mapInPandas(work, FRAMES)


@F.pandas_udf(T.BinaryType())
def blend_images(p: pd.Series, s: pd.Series, alpha: pd.Series) -> pd.Series:
    """lerp() of the bytes of two images."""

    def one(a, b, t):
        if a is None or b is None:  # an end that can't be read: the other stands for both
            return b if a is None else a
        x, y = np.frombuffer(a, np.uint8).astype(np.float32), np.frombuffer(b, np.uint8).astype(np.float32)
        return np.clip(x * np.float32(1 - t) + y * np.float32(t), 0, 255).astype(np.uint8).tobytes()

    return pd.Series([one(*x) for x in zip(p, s, alpha)])


def preview(frames: DataFrame, marks: DataFrame, scale: float = 0.4) -> DataFrame:
    """Small frames, those with a mark in a red border of five pixels."""
    from framewell.operators.marks import with_marks

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b.drop(columns="marked")
            out = []
            for d, w, h, marked in zip(b["data"], b["width"], b["height"], b["marked"]):
                image = resize(pixels_of(d, w, h), max(int(w * scale), 1), max(int(h * scale), 1)).copy()
                if marked:
                    for part in (image[:5], image[-5:], image[:, :5], image[:, -5:]):
                        part[...] = (0, 0, 255)
                out.append(image)
            c["width"], c["height"], c["data"] = [x.shape[1] for x in out], [x.shape[0] for x in out], [x.tobytes() for x in out]
            yield c

    return with_marks(frames.where("data is not null"), marks).select("video_id", "fn", "msec", "width", "height", "data", "marked").mapInPandas(work, FRAMES)
