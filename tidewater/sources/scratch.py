"""Tables that one query writes and reads again."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process, for clear().
_MADE: list[str] = []


@lru_cache(1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidewater-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that is unset, a session of one machine (tests) gets a temporary folder; on a cluster, where each
    executor would write to a disk of its own, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = _local()
    _MADE.append(f"{base.rstrip('/')}/tidewater-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this process has made so far, and tells how many: call it when the results that read them are written."""
    done = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done
