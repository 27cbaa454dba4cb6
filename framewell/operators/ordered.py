"""Ordered operations that don't put a whole key into one task.

Rows of a key are cut into chunks of the order; what a chunk needs of those before or after it is a
summary row of each, so windows run over (key, chunk) and over summaries only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def chunked(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))


def running_count(df: DataFrame, key: str, order: str, flag: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the number of rows up to and including each, in its key, for which flag holds."""
    df = chunked(df.withColumn("_flag", flag.cast("long")), order, chunk)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, "_chunk").agg(F.sum("_flag").alias("_sum"))
    sums = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(sums, [key, "_chunk"])
    return df.withColumn(name, F.sum("_flag").over(within) + F.col("_before")).drop("_flag", "_before", "_chunk")


def nearest(df: DataFrame, key: str, order: str, flag: Column, chunk: int = CHUNK) -> DataFrame:
    """df with previous_marked and next_marked: the nearest row before and after each for which flag holds."""
    df = chunked(df.withColumn("_at", F.when(flag, F.col(order))), order, chunk)
    ends = df.groupBy(key, "_chunk").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    # Both look back, the second in descending order: a frame that grows row by row is never read again.
    back = lambda c, keys, by: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(key, "_chunk", back("_hi", [key], "_chunk").alias("_before"), back("_lo", [key], F.desc("_chunk")).alias("_after"))
    df = df.join(ends, [key, "_chunk"])
    previous, following = back("_at", [key, "_chunk"], order), back("_at", [key, "_chunk"], F.desc(order))
    return df.withColumns({"previous_marked": F.coalesce(previous, "_before"), "next_marked": F.coalesce(following, "_after")}).drop("_at", "_before", "_after", "_chunk")


def history(df: DataFrame, key: str, order: str, value: str, depth: int = 4, chunk: int = CHUNK) -> DataFrame:
    """df with h0..h{depth-1}: the row's value and those of the rows before it.

    Before a key's first row its first value repeats.  A chunk gets the last depth - 1 rows of the
    chunks before it; as each chunk has a row at least, depth - 1 summaries hold them.
    """
    back = depth - 1
    df = chunked(df, order, chunk)
    down = Window.partitionBy(key, "_chunk").orderBy(F.desc(order))
    last = df.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= back)
    tails = last.groupBy(key, "_chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("_tail"))
    firsts = df.groupBy(key).agg(F.min_by(value, order).alias("_first"))
    w = Window.partitionBy(key).orderBy("_chunk")
    none = F.slice("_tail", 1, 0)
    all_before = F.concat(*[F.coalesce(F.lag("_tail", k).over(w), none) for k in range(back, 0, -1)])
    tails = tails.select(key, "_chunk", F.reverse(all_before).alias("_back")).join(firsts, key)
    df = df.join(tails, [key, "_chunk"])
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    df = df.withColumn("_at", F.row_number().over(w))
    found = {"h0": F.col(value)}
    for i in range(1, depth):
        found[f"h{i}"] = F.coalesce(F.lag(value, i).over(w), F.get("_back", F.lit(i) - F.col("_at")), F.col("_first"))
    return df.withColumns(found).drop("_at", "_back", "_first", "_chunk")
