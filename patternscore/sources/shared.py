"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on this machine (tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_dirs.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _own_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved() tables that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def mark() -> int:
    """A point for dropped_since()."""
    return len(_written)


def dropped_since(spark: SparkSession, point: int, *but: DataFrame) -> None:
    """Delete what was written to the shared folder after mark() gave ``point``, except the saved() tables ``but``.

    Results are lazy, so this comes after the result that reads these tables is written.
    """
    kept = {df._saved_at for df in but}
    for path in _written[point:]:
        if path not in kept:
            _delete(spark, path)
    _written[point:] = [p for p in _written[point:] if p in kept]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
