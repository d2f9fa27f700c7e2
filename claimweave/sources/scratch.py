"""Tables between steps, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from .files import delete

#: Where tables that ``stored`` gave lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session of one machine, as in tests, gets its own where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all that this application stores."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored. Results that were not written elsewhere can't be read any more."""
    delete(spark, session_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by a hash of columns over all the session's partitions, which adaptive execution doesn't merge: for rows that are small, and
    so lie in few files or partitions, but take long or become many."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: all that came of them is stored itself."""
    for df in frames:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)
