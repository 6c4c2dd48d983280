"""Session settings of the Python kernels, and tables that are written in the middle of a plan.

Nothing here looks at values: an empty table is written and read back as an empty table of the same columns.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of column data handed to a Python worker at once; keeps a worker's memory flat for documents of any length.
ARROW_BATCH_BYTES = 2 << 20
ARROW_BATCH_ROWS = 4000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by bytes and by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > ARROW_BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves a local master, whose threads all see it; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "palimpsest-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palimpsest/{tag}-{uuid.uuid4().hex}"


#: Rows of a narrow table (a few numbers each) that make up one partition.
NARROW_ROWS = 50_000


def cut(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in a shared folder and read it back: the lineage ends there and survives lost executors.

    ``rows``: a bound on its rows, where one is known. A narrow table is then written in as many parts as that asks
    for, and not in one for each shuffle partition.
    """
    path = f"{folder}/{name}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // NARROW_ROWS)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once in a folder of its own: what is made of it several times does not run its kernels again."""
    return cut(df, shared_dir(df.sparkSession, tag), "rows")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``cut`` wrote and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Bytes of files up to which a table may be read as fewer parts than there are cores.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a small table is in fewer files than there are cores. Any other stays as it is read: large files
    are read in parts, and many files are many parts."""
    spark = df.sparkSession
    n, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= n:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.repartition(n) if size <= SMALL_BYTES else df
