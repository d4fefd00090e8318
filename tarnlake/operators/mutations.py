"""Mutations of keyed rows as joins: overlays, replacement, compare-and-set and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import Conflict
from ..sources.scratch import parts, small, spread


def resolved(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row for each key: the last one by `order`, which is dropped. Without an order a key that repeats is an error when it is read."""
    others = [c for c in rows.columns if c not in (key, order)]
    if not others:
        return spread(rows.select(key), key).distinct()
    row = F.struct(*others)
    if order:
        return rows.groupBy(key).agg(F.max_by(row, order).alias("_row")).select(key, "_row.*")
    one = F.when(F.count(F.lit(1)) == 1, F.first(row)).otherwise(F.raise_error(F.concat(F.lit("a key has several writes and no order: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return spread(rows, key).groupBy(key).agg(one.alias("_row")).select(key, "_row.*")


def overlaid(base: DataFrame, pending: DataFrame, key: str, deleted: str = "deleted", order: str | None = None) -> DataFrame:
    """base as a transaction sees it: its own writes and deletes, the last of a key, hide what was there."""
    pending = resolved(pending, key, order)
    return base.join(small(pending.select(key)), key, "left_anti").unionByName(pending.where(~F.col(deleted)).drop(deleted))


def put(base: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows replace those with their key in full; fields they lack become absent."""
    rows = resolved(rows, key, order)
    return base.join(small(rows.select(key)), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def split(base: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """base with what is wanted of its rows (`_wanted` marks them), and the wanted rows whose key base lacks; base moves only if wanted is large, and then over tasks of bounded size."""
    if parts(wanted) > 1:
        n = parts(base, 100_000)  # whole rows are sorted, maps among them
        base, wanted = base.repartition(n, key), wanted.repartition(n, key)
    marked = small(wanted.withColumn("_wanted", F.lit(True)))
    there = base.select(key).join(small(wanted.select(key)), key, "left_semi")
    return base.join(marked, key, "left"), wanted.join(small(there), key, "left_anti")


def require_none(conflicts: DataFrame, collection: str, key: str) -> None:
    """Raise the first of the conflicts, if there is one."""
    if found := conflicts.orderBy(key).first():
        raise Conflict(f"{collection} {found[key]}: {found['reason']}", collection, str(found[key]), found["reason"])


def wrapped(a: Column, b: Column) -> Column:
    """a + b in 64-bit two's complement."""
    wide = F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)") + F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)"))
    return (wide - F.lit("9223372036854775808").cast("decimal(38,0)")).cast("long")


def compare_and_set(base: DataFrame, wanted: DataFrame, key: str, holds: Column, patches: dict[str, Column], absent_ok: bool = False, mismatch: str = "ExpectedFieldMismatch", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Base after the update, and the conflicts (key, reason).

    wanted: a row for each key to update (the last by `order`), with what `holds` and `patches` refer to. A patch that is a
    null column removes the field. `mismatch` is the reason given where the condition fails, and where base lacks the key,
    unless absent_ok.
    """
    wanted = resolved(wanted, key, order)
    joined, lacking = split(base, wanted, key)
    joined = joined.withColumn("_ok", F.coalesce(F.col("_wanted") & holds, F.lit(False)))
    after = joined.select(key, *(F.when(F.col("_ok"), patches[c]).otherwise(F.col(c)).alias(c) if c in patches else F.col(c) for c in base.columns if c != key))
    conflicts = joined.where("_wanted and not _ok").select(key, F.lit(mismatch).alias("reason"))
    if not absent_ok:
        return after, conflicts.unionByName(lacking.select(key, F.lit(mismatch).alias("reason")))
    empty = lacking.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name not in lacking.columns))
    return after.unionByName(empty.select(key, *(patches[c].alias(c) if c in patches else F.col(c) for c in base.columns if c != key))), conflicts
