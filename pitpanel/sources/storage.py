"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Set the checkpoint folder from ``spark.checkpoint.dir``; a temporary one only where the
    session runs in one process and names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="pitpanel-")
    context.setCheckpointDir(folder)


def materialised(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: plans built on them start anew.

    Cached tables inside cached tables would each carry the plans below them, and iterated
    plans would grow without bound; a lost executor loses no checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that isn't in use."""
    checkpoint_dir(spark)
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
