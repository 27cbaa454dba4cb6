"""Scalar functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The luminance weights of the stored channels 0, 1, 2.
LUMA = (0.2126, 0.7512, 0.0722)


def fourcc(code: Column) -> Column:
    """The four characters of an int, lowest byte first."""
    return F.concat(*[F.char(F.shiftright(code, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)])


def timecode(msec: Column, corrected: bool = False) -> Column:
    """hh:mm:ss:mmmm of a position in milliseconds.

    As the tools print it, seconds lose 60 for each minute *of the hour* and milliseconds lose only
    the seconds that are left, so positions of a minute and more carry the rest along;
    corrected=True gives the remainders.
    """
    s = F.floor(msec / 1000)
    m = F.floor(s / 60)
    h = F.floor(m / 60)
    m = m - 60 * h
    s = s - 60 * m - (3600 * h if corrected else 0)
    ms = F.floor(msec - 1000 * (F.floor(msec / 1000) if corrected else s))
    return F.format_string("%02d:%02d:%02d:%04d", h.cast("long"), m.cast("long"), s.cast("long"), ms.cast("long"))


def input_list(text: Column) -> Column:
    """A comma-separated list of inputs, each without white space around it."""
    return F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def clamp(x: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """x within bounds; null stays null, which greatest() and least() would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def luminance(c0: Column, c1: Column, c2: Column) -> Column:
    return (LUMA[0] * c0 + LUMA[1] * c1 + LUMA[2] * c2) / 255


def tone(value: Column, gain: float = 1.0, bias: float = 0.0, gamma: float = 1.0) -> Column:
    """(t ^ gamma * gain + bias) * 255 of t = value in 0..1, clamped and truncated."""
    return clamp((F.pow(value, F.lit(gamma)) * gain + bias) * 255).cast("int")


def lerp(p: Column, s: Column, alpha: Column) -> Column:
    """p * (1 - alpha) + s * alpha, clamped to a byte and truncated."""
    return clamp(p * (1 - alpha) + s * alpha).cast("int")


def sigmoid(x: Column, beta: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-beta * x))


def sigmoid_slope(v: Column) -> Column:
    """The slope in terms of the activation, without beta."""
    return v * (1 - v)


def percentage(fraction: Column) -> Column:
    """Truncated to an int; null stays null."""
    return (fraction * 100).cast("int")
