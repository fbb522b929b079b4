"""Cutting lineage with files in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and everything runs on this machine, as in tests.
LOCAL_DEFAULT = "file:///tmp/kinetrail-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster it must be named: a machine's own disk would lose rows."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = LOCAL_DEFAULT
    return where.rstrip("/")


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetrail/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of settled frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path is not None:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
