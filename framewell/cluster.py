"""What a cluster needs: the package on its executors, and a folder that all of them see."""

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application.

    Functions that run there are pickled by reference, so their modules must import there too,
    wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("framewell", os.path.relpath(full, top)))
    # Through Spark's file systems, as the shared folder may be in any of them.
    path = f"{shared_dir(spark)}/framewell.zip"
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is worked out once, and lost executors don't bring it back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the session has none, as in tests, a folder of the warehouse is set; on a cluster that must not
    be a local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.warehouse.dir").startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/framewell-{uuid.uuid4().hex}"
