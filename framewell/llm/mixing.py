"""Mixing sources to target weights.

Tokens are summed per source, targets follow the weights up to a largest number of repetitions, and
each document is emitted floor(rate) times plus one more copy, drawn from a hash of its id and a
seed, with probability rate - floor(rate).  DataFrame functions only; the documents themselves are
never shuffled: only (source, size) sums and a table of one row per source are.

Defined results: a null text has size 0; a null source is a source of its own, after all others;
rows that repeat a doc_id share its draw; an empty table gives an empty result; a source whose
documents are all empty gets target 0 and rate 0; further columns of any name come along as they are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.llm.common import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 11


def word_count(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, size) -> one row per source: source, weight, source_size, target.

    The weights go round over the sources in order of code points, null last.  The targets share
    `share` times all sizes by weight; none is above `most` times its source's size, and what a full
    source can't take is shared by weight among the others.  Sources in ascending order of
    size / weight fill up first, so one pass over that order finds which are full: those for which
    most * size is at most weight times what is left over the weight that is left.  One row per
    source is all that meets in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("nth", nth).withColumn("weight", w)
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "left_size": F.lit(float(share)) * F.sum("source_size").over(every) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    full = F.lit(float(most)) * F.col("source_size") * F.col("left_weight") <= F.col("weight") * F.col("left_size")
    # The first source that isn't full sets the rate of all after it.
    rate = F.first(F.when(~full, F.col("left_size") / F.col("left_weight")), ignorenulls=True).over(every)
    first_open = F.min(F.when(~full, F.col("nth_up"))).over(every)
    per = per.withColumn("nth_up", F.row_number().over(up)).withColumns({"rate": rate, "open_from": first_open})
    target = F.when(F.col("nth_up") < F.coalesce(F.col("open_from"), F.lit(2**31 - 1)), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * F.col("rate"))
    return per.select("source", "weight", "source_size", target.alias("target"))


def draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and id, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """docs -> row (a struct of its columns), size, source_size, target, copies (long): how often the mix has it.

    `size` is a document's size where docs has it already, as words are counted once for the sums and,
    if the result's size is used, once again.
    """
    size = word_count(text_col) if size is None else size
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    targets = source_targets(sized.select("source", "size"), weights, share, most).select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    n = F.floor(rate) + (draw("id", seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", n.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row as often as copies() says, with the columns of docs."""
    c = copies(docs, **options)
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return c.where("copies > 0").select("row", again.alias("again")).select("row.*")
