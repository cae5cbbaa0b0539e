"""Reading tables and writing intermediate ones for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lists of sources are broadcast up to this many rows (a few MB); beyond it joins shuffle.
BROADCAST_ROWS = 50_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    Where none is set, a local session uses its warehouse; a cluster must name one, as a
    folder of the driver's machine would not do.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: no lineage, no lost blocks.

    The folder is the session's own; what is in it can be deleted when the session has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, one row per source, marked for broadcast if a count shows at most ``rows`` rows, else unmarked.

    Pass a durable frame: the count reads it once more.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rows_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, a few MB at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


class Collector:
    """Gathers output rows and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_bytes: int = 8 << 20, max_rows: int = 50_000):
        self.schema, self.max_bytes, self.max_rows = schema, max_bytes, max_rows
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    @property
    def full(self) -> bool:
        return self.bytes >= self.max_bytes or len(self.rows) >= self.max_rows

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
        )
        self.rows, self.bytes = [], 0
        return out
