"""Cutting long plans: a table that many branches read is written once, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and kept in spark.checkpoint.dir; what reads it neither plans nor computes it again.

    Where the setting is missing a local session gets a folder of its own; a
    cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="voicegauge-")
        context.setCheckpointDir(base)
    return df.checkpoint()
