"""Runs over a stream that can be stopped at any point and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resumable(
    stream: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    written: Callable[[int], None] = lambda batch: None,
) -> None:
    """Put what ``work`` makes of each batch of ``stream`` under ``sink``, until all that is there is done.

    The checkpoint knows which input each batch number stands for, and a batch's rows lie in
    the folder of its number. A run that ends between the write and the checkpoint's commit
    repeats the batch with the same input into the same folder, so each row is there once.
    ``written`` is called after a batch is written and before it is committed.
    """

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        written(number)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def done(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """What runs have put under ``sink``, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(sink)


def remaining(wanted: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` that no run has finished, in the order that they are to be taken up."""
    return wanted.join(finished.select(key).distinct(), key, "left_anti").orderBy(key)


def interrupted(runs: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Runs that are still marked running, have rows left and began over ``minutes`` before ``now``."""
    stale = F.col("started_at") < now - F.make_interval(mins=F.lit(minutes))
    return runs.where((F.col("status") == "running") & (F.col("left") > 0) & stale)
