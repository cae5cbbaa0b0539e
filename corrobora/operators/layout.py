"""How rows lie before work that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys``: groups and windows over them and further columns need no other shuffle.

    Deal narrow rows, before they are taken apart. The number of parts is that of the session's
    shuffles; the parts are not merged again, as the work on them is many times their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
