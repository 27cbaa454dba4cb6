"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import sql
from framewell.llm.common import keep, shared_dir, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.warc import RECORD, read, write

    path = shared_dir(spark)
    write(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.substr(F.col(c), F.lit(len(RECORD) + 1)).try_cast("long")
    records = read(spark, path, payload=False)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.topk import quantize, top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantize("embedding").alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.url_filter import judge

    return judge(spark, table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.winnow import digest, edited, hashes, likeness

    e = edited(table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id",
        F.col("_chars").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        digest("_fp").alias("fingerprint"),
        digest("_edited_fp").alias("edited_fingerprint"),
        likeness(F.col("_hashes"), hashes("_edited_fp")).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next")).alias("near_next"),
        # With the ids both uses of the dealt rows read the same columns, so that they are shuffled once.
        F.col("_next_id").alias("next_id"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.mixing import copies, word_count

    # Ids, sources and sizes are written once, so that words are counted once.
    docs = keep(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")))
    return copies(docs, size=F.col("size")).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.cotrain import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framewell.llm.jaccard import components

    return components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_top_k, op3_bpe, op4_url_filters, op5_fingerprints, op6_mixing, op7_html_extraction, op8_token_counts, op9_quality, op10_ngram_jaccard)}


def oracle_sql() -> dict:
    return {"op1_warc": sql.WARC, "op2_top_k": sql.TOP_K, "op4_url_filters": sql.URL_FILTERS, "op6_mixing": sql.MIXING, "op10_ngram_jaccard": sql.JACCARD}
