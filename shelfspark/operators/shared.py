"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, place: str) -> None:
    """Removes a folder, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        delete(spark, place)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage, survives a lost executor. It goes when the driver ends."""
    place = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    atexit.register(_at_exit, df.sparkSession, place)
    kept = df.sparkSession.read.schema(df.schema).parquet(place)
    kept.kept_at = place
    return kept
