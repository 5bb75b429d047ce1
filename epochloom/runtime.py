"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where neither the setting nor
    the context has one (local tests) a private folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="epochloom-ckpt-")
    sc.setCheckpointDir(wanted)
    return wanted


def spill(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the checkpoint folder and read it from there.

    For results that several branches of a plan need: it is computed once, survives the loss of executors, and
    its real size decides whether a join may broadcast it. The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
