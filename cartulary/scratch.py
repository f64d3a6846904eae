"""Lineage cuts: intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master (tests, one machine) gets a temporary one; a cluster has none that all share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_cartulary_scratch", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark._cartulary_scratch = tempfile.mkdtemp(prefix="spark-cartulary-", dir="/tmp")
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps start from files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cartulary_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() has written. Nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cartulary_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
