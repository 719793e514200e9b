"""Cutting lineage in loops: reliable checkpoints in the folder the cluster names."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch(spark, label: str) -> str:
    """A path that nothing uses yet, in the folder named by ``spark.checkpoint.dir`` (see ``checkpointed``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    The folder comes from ``spark.checkpoint.dir``.  Where that is unset a temporary one is used if Spark runs in one
    process; on a cluster, whose executors would each write to a disk of their own, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by all that follows, safe from lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
