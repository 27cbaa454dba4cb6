"""What a run tells of itself: counts gathered while frames pass, without a pass of their own."""

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger("framewell")


def observed(frames: DataFrame, name: str = "frames") -> tuple[DataFrame, Observation]:
    """frames as they are, and what the first action on them counts: frames, unreadable, first_fn, last_fn."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("frames"), F.count_if(F.col("data").isNull()).alias("unreadable"), F.min("fn").alias("first_fn"), F.max("fn").alias("last_fn")]
    return frames.observe(seen, *counts), seen


def log(seen: Observation) -> dict:
    """The counts, written to the log as well; it waits for the action."""
    counts = seen.get
    LOG.info("%(frames)s frames, %(unreadable)s of them unreadable, from %(first_fn)s to %(last_fn)s", counts)
    return counts
