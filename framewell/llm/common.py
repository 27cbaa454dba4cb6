"""What the operators share: tables kept in the folder that all executors see, words, ids on their way to Python."""

import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.cluster import shared_dir

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of `rows`, where the session has Spark's default of ten times as many.

    A worker and its executor each hold a batch or two, and texts are long.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, executors may go."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def let_go(result=None):
    """Give what this Python worker has freed back to the system, and pass `result` on.

    Workers live on between tasks and stages, and what their allocators hold counts against the executor.
    """
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
    return result


def as_text(df: DataFrame, *columns: str):
    """df with the columns as strings, and what turns a result's columns of those names back.

    pandas holds integers with a null among them as floats, which would round ids of over 53 bits.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    return df.withColumns({c: F.col(c).cast("string") for c in columns}), lambda out: out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
