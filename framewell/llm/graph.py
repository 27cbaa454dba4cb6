"""Distributed connected components."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import drop_kept, keep


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(src, dst) of any one orderable type -> (node, component), component its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every node hands its larger
    neighbours, then its smaller ones, to the smallest of them, until all are stars; that takes
    O(log^2 n) rounds, and none where the edges are stars already.  The minimum of a neighbourhood is aggregated before the shuffle and joined
    back, so a node with a third of all edges is no hot task: its minimum is one row and the join's
    other side can be split.  Each round is a table in the shared folder, so a lost executor costs
    a part of one round.  Edges with a null end and loops join nothing; their nodes aren't returned.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("src is not null and dst is not null and src <> dst").distinct()
    current = keep(e)
    paths = [_path(current)]
    for _ in range(most_rounds):
        if _settled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # large-star edges point from a node to a smaller one; small-star joins a node's smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = keep(small)
        paths.append(_path(after))
        current = after
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    drop_kept(spark, *paths[:-1])
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none: stars, which need no round."""
    most = edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return most <= 1 and edges.select("b").distinct().join(edges.select("a"), F.col("b") == F.col("a"), "left_semi").isEmpty()


def _path(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""
