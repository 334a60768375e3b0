"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import quillspark

# Functions that run in tasks travel with them, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(quillspark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster.

    Only a session on one machine that names none (as in tests) gets a folder of its own; on a cluster a folder of one
    machine would lose data between executors, so the setting is asked for.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not given:
        given = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"quillspark-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


#: Folders this process has written; ``release`` removes them.
_WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a table written to the shared folder, so a lost executor costs no recomputation
    and a result that feeds several branches is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the intermediate tables written so far; call it when the results that read them are written or done with."""
    jvm = spark.sparkContext._jvm
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
