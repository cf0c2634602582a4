"""Cutting a plan's lineage by reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder: what is built on it several times doesn't plan and run it again.

    The folder is ``spark.checkpoint.dir``; where it is unset, a local one serves on a local master alone.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="barline-"))
    return df.checkpoint()
