"""Sessions and tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one side of a join up to which they go to every task.
MOST_TOLD = 200_000


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; on a cluster, ``master`` and sizes come from spark-submit."""
    builder = SparkSession.builder.master(master).appName("strandline").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets one of its own, which is
    then set; on a cluster that is an error, as other machines wouldn't see the folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in the application's own part, which is deleted when the application ends."""
    root = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """One side of a join, ``rows`` being its number if that is known: few rows go to every task, more are dealt out by key.

    Spark's own check goes by the bytes of files. Packed columns of millions of rows can pass it, and then take a hundred times
    as much in the driver's memory. A side that is large anyhow gets the same hint where it is joined."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_TOLD else df.hint("merge")
