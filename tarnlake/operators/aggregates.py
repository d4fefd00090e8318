"""The five scalar aggregates: over rows already filtered, sorted and limited.

Count counts rows. The others skip absent, null, non-numeric and non-finite values; an integer sum saturates at the
64-bit bounds; any finite float turns sum, min and max of a mixed field into floats; avg is a float; with no number
the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import FLOAT, INT, payload, rank_of_type, value, VALUE

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def saturated(total: Column) -> Column:
    return F.when(total > HIGH, HIGH).when(total < LOW, LOW).otherwise(total).cast("long")


def typed(kind: str, field: str | None, schema: T.StructType) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    known = {f.name: f.dataType for f in schema.fields}
    rank = rank_of_type(known[field]) if field in known else None
    if rank not in (INT, FLOAT):
        return F.max(F.lit(None).cast("double"))
    c = payload(F.col(f"`{field}`"), known[field])
    c = c if rank == INT else finite(c.cast("double"))
    if kind == "sum":
        return saturated(F.sum(c.cast("decimal(38,0)"))) if rank == INT else F.sum(c)
    if kind == "avg":
        return F.avg(c.cast("double"))
    return {"min": F.min, "max": F.max}[kind](c.cast("long") if rank == INT else c)


def dynamic(kind: str, field: str | None, fields: str = "fields") -> Column:
    """A value struct; for count a long."""
    if kind == "count":
        return F.count(F.lit(1))
    v = F.col(fields)[field]
    i, f = F.when(v["t"] == INT, v["i"]), F.when(v["t"] == FLOAT, finite(v["f"]))
    number = F.coalesce(f, i.cast("double"))
    if kind == "avg":
        return F.when(F.count(number) > 0, value(F.avg(number), FLOAT)).otherwise(F.lit(None).cast(VALUE))
    if kind == "sum":
        whole, broken = saturated(F.sum(i.cast("decimal(38,0)"))), F.sum(number)
    else:
        by = {"min": F.min, "max": F.max}[kind]
        whole, broken = by(i), by(number)
    return F.when(F.count(f) > 0, value(broken, FLOAT)).when(F.count(i) > 0, value(whole, INT)).otherwise(F.lit(None).cast(VALUE))
