"""Cutting lineage and keeping intermediate tables: the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it.

    Only a session in one JVM (master local or local[n]) that names no folder gets a temporary one of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not root and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="cairnflow-"))
    return sc.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """frame, written to the shared folder and read from there, so that it outlives lost executors."""
    scratch_folder(frame.sparkSession)
    return frame.checkpoint()
