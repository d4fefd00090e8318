"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of sessions without spark.checkpoint.dir, which can't be set on a running session.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tarnlake-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: lineage is cut and lost executors cost nothing."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A broadcast hint if df, counted here, has at most so many (narrow) rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts(df: DataFrame, rows: int = 250_000) -> int:
    """How many tasks df, counted here, needs if each is to hold about so many rows."""
    return max(1, -(-df.count() // rows))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as its rows need, so that a task's memory does not follow the table; a small one as it is."""
    n = parts(df)
    return df.repartition(n, *keys) if n > 1 else df
