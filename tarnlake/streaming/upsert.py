"""A change stream folded into the newest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import newest


def upsert(changes: DataFrame, path: str, checkpoint: str, key: str, order: str, deleted: str, *columns: str) -> StreamingQuery:
    """Each batch appends its newest change by key to a batch folder of its number, so that a repeated batch replaces itself; state() reads them."""

    def fold(batch: DataFrame, number: int) -> None:
        newest(batch, key, order, order, deleted, *columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark, path: str, key: str, order: str, deleted: str, *columns: str) -> DataFrame:
    """The live rows over all batches."""
    return newest(spark.read.parquet(path), key, order, deleted, *columns).where(~F.col(deleted)).drop(deleted)
