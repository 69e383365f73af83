"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in local mode, as in tests, one of our own.

    On a cluster an unset folder raises, since no machine's own folder would do.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        own = context._jsc.sc().getCheckpointDir().get()
        files, place = _file_system(spark, own)
        files.deleteOnExit(place)  # what checkpoint() leaves there goes with the process
    return context._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; it goes when the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it is missing."""
    files, place = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, until the session's process ends."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_on_disk(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the shared folder for as long as the block lasts; a lost executor loses nothing of it."""
    path = new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(df.sparkSession, path)
