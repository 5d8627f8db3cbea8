"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A folder of this machine serves only where none is set and Spark runs on this machine alone; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="strandline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """Computed once and written to the shared folder, so that lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
