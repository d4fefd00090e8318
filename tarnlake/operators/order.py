"""Places in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import save


def placed(rows: DataFrame, *columns: str) -> DataFrame:
    """Sorted rows with `place`, from 1 on: written by ranges, counted per range, numbered by offset and place inside."""
    spark = rows.sparkSession
    inside = (1 << 33) - 1  # the lower bits of the id count the rows of a range
    held = save(spark, rows.select(*columns, F.monotonically_increasing_id().alias("_at")), "ordered").withColumn("_range", F.shiftright("_at", 33))
    starts, total = [], 0
    for part, n in sorted(map(tuple, held.groupBy("_range").count().collect())):  # a row for each range
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "_part long, _offset long")
    return held.join(F.broadcast(offsets), F.col("_range") == F.col("_part")).select(*columns, (F.col("_offset") + F.col("_at").bitwiseAND(inside) + 1).alias("place"))
