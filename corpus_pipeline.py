"""The corpus pipeline: classify, remove near duplicates, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents, and
further columns of any name are left out.

Defined results: null and empty texts are scored by the classifier's biases, never duplicates of each
other, of size 0 for the mix and without tokens; null metadata is a value of its own; rows that repeat
an id are judged each by their own text, share the mix's draw, and are encoded each; equal texts are
one group whatever their ids; an empty table gives an empty result; texts of any length are read whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import bpe, cotrain, jaccard, mixing
from framewell.llm.common import keep, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    small_batches(spark)
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model, columns=COLUMNS).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: that with the smallest id, null last.

    Rows without words are kept as they are.  The decision is a row's own: of rows that share a group's
    smallest id the least by text class and other columns stays, and rows of that id in other groups
    have nothing to do with it.
    """
    small_batches(spark)
    found = jaccard.components(docs.select(*COLUMNS), carry=True)
    stays = found.where("n_shingles = 0 or doc_id <=> component_id").select("row", "n_shingles", "cls", "component")
    several = stays.where("n_shingles > 0").groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    if several.isEmpty():
        return stays.select("row.*")
    several = keep(several)
    one = stays.where("n_shingles = 0").unionByName(stays.where("n_shingles > 0").join(several, "component", "left_anti")).select("row.*")
    least = F.min(F.struct("cls", "row.lang", "row.source", "row.n_chars", "row"))
    return one.unionByName(stays.where("n_shingles > 0").join(several, "component", "left_semi").groupBy("component").agg(least.alias("r")).select("r.row.*"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it."""
    return mixing.mix(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens of each document's every copy, and the digests of its ids and of what they decode to."""
    small_batches(spark)
    return bpe.digests(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mixing_weights), ("BPE encoding and decoding", encoding)]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as a table in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
