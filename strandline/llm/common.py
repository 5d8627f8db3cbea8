"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors recompute nothing before this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def place_of(docs: DataFrame) -> Column | None:
    """File and row of each row, which don't change from scan to scan; None for rows that come from no file."""
    try:
        names = docs.select("_metadata.*").columns if "_metadata" not in docs.columns else []
    except AnalysisException:
        names = []
    if not {"file_path", "row_index"} <= set(names):
        return None
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that an operator writes for itself in the shared folder; each is deleted when all that reads it is settled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, kind: str = "table") -> DataFrame:
        path = fresh_path(self.spark, kind)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join with at most so many rows of a few numbers each is broadcast (about 30 MB); a longer one is sorted and merged.
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, which must be cheap to count, with a broadcast hint if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
