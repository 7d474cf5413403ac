"""Intermediate results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary folder of this machine only where none is set, as in tests.

    With executors on other machines such a folder would lose rows, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="terravow-"))
        folder = _own[0]
    _made.append(f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read again: lineage ends here, and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Removes what this process has written below :func:`shared_path`; results read from it must be used up before."""
    jvm = spark.sparkContext._jvm
    for path in _made:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()
