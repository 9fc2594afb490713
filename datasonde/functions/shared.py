"""The shared folder of the cluster, for what jobs have to keep."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a local master, as in a test, may go without the setting and gets a temporary
    folder; elsewhere each executor would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} has no folder that all executors share")
        root = tempfile.mkdtemp(prefix="datasonde-")
    return f"{root.rstrip('/')}/datasonde-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed, so that its uses survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    For tables as long as the input: compressed, read column by column, and of known size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
