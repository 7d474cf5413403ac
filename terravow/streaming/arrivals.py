"""Streams whose rows arrive out of order: replay by arrival, and late rows kept apart row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_path, written

FILES = 4


def replayed(rows: DataFrame, arrived: Column, slice_seconds: int, last: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream in the order of their arrival, in slices of it; ``_slice`` numbers them.

    Within a slice rows lie in any order, as they do in a batch of a log. Slices are written one after the other, since
    a file source goes by the time of writing. ``last`` is written behind all of them.
    """
    spark = rows.sparkSession
    held = rows.withColumn("_slice", arrived.cast("timestamp_ntz"))  # by the clock, whatever the session's zone
    held = written(held.withColumn("_slice", F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _slice)") / slice_seconds)), "arrivals")
    path = shared_path(spark, "source")
    for (number,) in held.select("_slice").distinct().orderBy("_slice").collect():  # one row a slice of time
        held.where(F.col("_slice") == number).repartition(FILES).write.mode("append").parquet(path)
    if last is not None:
        last.select(*(F.col(c) if c in last.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns)).write.mode("append").parquet(path)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def split_late(stream: DataFrame, at: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(kept, late) rows of a replayed stream, each once, and nothing lost: a row is late if it is older than the newest
    row of all earlier slices by more than ``delay``.

    A batch writes its rows and the newest time of each of its slices under its number. What it goes by are the times of
    batches before it, so a batch that is repeated after a failure writes the same rows to the same place.
    """
    spark = stream.sparkSession
    sink, marks = shared_path(spark, "split"), shared_path(spark, "marks")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("_slice").agg(F.max(at).alias("_newest"))
        known = spark.read.schema("_slice long, _newest timestamp, batch long").parquet(marks).where(F.col("batch") < number).drop("batch") if number else own.limit(0)
        own.write.mode("overwrite").parquet(f"{marks}/batch={number}")
        newest = known.unionByName(own).groupBy("_slice").agg(F.max("_newest").alias("_newest"))
        before = F.max("_newest").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # one row a slice
        mark = newest.select("_slice", (before - F.expr(f"INTERVAL {delay}")).alias("_mark"))
        late = F.coalesce(F.col(at) < F.col("_mark"), F.lit(False))
        batch.join(F.broadcast(mark), "_slice").withColumn("_late", late).drop("_mark").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(sink)
    return found.where("NOT _late").drop("_late"), found.where("_late").drop("_late")
