"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset, a session on this machine alone gets a temporary folder; a cluster is an error, since its
    executors don't see each other's folders.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))
    return f"{top.rstrip('/')}/weftline/{context.applicationId}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new name in the application's folder."""
    return f"{base(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a file of few row groups would leave most of them idle.

    A table that is in so many already, as large ones are, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean(spark: SparkSession) -> bool:
    """Deletes all work tables of this application, after which results that stand on them can't be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
