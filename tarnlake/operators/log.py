"""Change logs: the newest write of a key wins, tombstones hide older values, transactions count once committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import parts, small


def newest(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each key, tombstones included.

    Structs are aggregated by sorting, so a large log is dealt over tasks of bounded size first: by key and one of 64 parts
    of a key's writes, so that a hot key is no task's alone, and then by key.
    """
    kept, n = F.max_by(F.struct(*columns), order), parts(log)
    if n > 1:
        log = log.select(key, order, *(c for c in columns if c not in (key, order)), F.pmod(F.xxhash64(order), F.lit(64)).alias("_part")).repartition(n, key, "_part")
        first = log.groupBy(key, "_part").agg(F.max(F.col(order)).alias("_order"), kept.alias("_row")).drop("_part").repartition(n, key)
        return first.groupBy(key).agg(F.max_by("_row", "_order").alias("_row")).select(key, "_row.*")
    return log.groupBy(key).agg(kept.alias("_row")).select(key, "_row.*")


def merged(log: DataFrame, key: str, order: str, deleted: str, *columns: str) -> DataFrame:
    """The live state: the newest value of each key that is no tombstone."""
    return newest(log, key, order, deleted, *columns).where(~F.col(deleted)).drop(deleted)


def point(log: DataFrame, key: str, value, order: str, deleted: str, *columns: str) -> DataFrame:
    """The live value of one key; the filter reaches the scan."""
    return merged(log.where(F.col(key) == value), key, order, deleted, *columns)


def scanned(log: DataFrame, key: str, order: str, deleted: str, *columns: str, start=None, end=None, tombstones: bool = False) -> DataFrame:
    """Keys in [start, end)."""
    if start is not None:
        log = log.where(F.col(key) >= start)
    if end is not None:
        log = log.where(F.col(key) < end)
    return newest(log, key, order, deleted, *columns) if tombstones else merged(log, key, order, deleted, *columns)


def replayed(log: DataFrame, tx: Column, commit: Column) -> DataFrame:
    """Rows outside transactions, and those of transactions of which a commit row exists."""
    log = log.withColumn("_tx", tx)
    commits = log.where(commit & F.col("_tx").isNotNull()).select("_tx").distinct()
    return log.where("_tx is null").unionByName(log.join(small(commits), "_tx", "left_semi")).drop("_tx")


def compact(log: DataFrame, key: str, order: str, deleted: str, *columns: str, path: str, files: int | None = None) -> None:
    """Write the live state as disjoint key ranges in key order: scans prune files by their footers."""
    live = merged(log, key, order, deleted, *columns)
    ranged = live.repartitionByRange(files, key) if files else live.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
