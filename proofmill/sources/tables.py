"""Tables that one step writes and several later ones read, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which ``spark.checkpoint.dir`` names; where that is unset, one in the warehouse.

    A warehouse on one machine's disk serves only sessions on that machine. What an application leaves goes when it ends.
    """
    sc = spark.sparkContext
    if not (found := sc.getCheckpointDir()):
        named = sc.getConf().get("spark.checkpoint.dir")
        folder = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        if not named and folder.startswith(("file:", "/")) and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine, which others on the cluster can't read")
        sc.setCheckpointDir(folder)
        found = sc.getCheckpointDir()
        path = sc._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: what several branches of a plan need is computed once and outlives executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
