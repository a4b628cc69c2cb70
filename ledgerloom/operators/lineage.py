"""Lineage of iterative jobs, cut at files that outlive any executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed and kept in spark.checkpoint.dir; without that setting a folder of this machine is used if Spark runs on it alone."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}")
    return df.checkpoint()
