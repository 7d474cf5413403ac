"""What the operators of this subpackage share: inputs, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's reader, so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a temporary folder made; with executors on other
    machines such a folder would lose rows, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="terravow-"))
    return _own_folder[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and several readers cost one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches_of(batches: Iterable[pa.RecordBatch], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes, or one row: memory follows the limit, not the row count."""
    for batch in batches:
        rows = batch.num_rows
        if rows and batch.nbytes > limit:
            step = max(1, int(rows * limit / batch.nbytes))
            for at in range(0, rows, step):
                yield batch.slice(at, step)
        elif rows:
            yield batch


def crc_part(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fixed folds of the learned operators."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def crc_part_py(ident: int | None, parts: int) -> int:
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % parts
