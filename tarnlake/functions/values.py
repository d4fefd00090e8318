"""Dynamic values: one struct that orders as the value types do.

Types rank null < bool < int < float < string < bytes; values of different types compare by rank alone. Spark compares
structs member by member with SQL NULL smallest, so plain comparisons and ORDER BY on the struct follow that order; an
absent field is a NULL struct. `z` is 0 for -0.0 and 1 for other floats, which puts -0.0 just below 0.0. Times are ints,
microseconds since 1970 in the session's time zone, and so are dates (their midnight); decimals are floats.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"t": "tinyint", "b": "boolean", "i": "bigint", "f": "double", "z": "tinyint", "s": "string", "x": "binary"}
VALUE = "struct<" + ",".join(f"{k}:{v}" for k, v in KINDS.items()) + ">"
NULL, BOOL, INT, FLOAT, STRING, BYTES = range(6)
PAYLOAD = {BOOL: "b", INT: "i", FLOAT: "f", STRING: "s", BYTES: "x"}


TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def plain(x):
    """A Python time or date as microseconds; anything else as it is."""
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        x = datetime.datetime(x.year, x.month, x.day)
    if isinstance(x, datetime.datetime):
        x = x if x.tzinfo else x.replace(tzinfo=datetime.timezone.utc)
        return (x - EPOCH) // datetime.timedelta(microseconds=1)
    return x


def payload(c: Column, kind: T.DataType) -> Column:
    """A typed column as the payload of its rank."""
    if isinstance(kind, TIMES):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("double") if isinstance(kind, T.DecimalType) else c


def rank_of_type(kind: T.DataType) -> int:
    for rank, types in ((BOOL, T.BooleanType), (INT, (T.IntegralType, *TIMES)), (FLOAT, (T.DoubleType, T.FloatType, T.DecimalType)), (STRING, T.StringType), (BYTES, T.BinaryType)):
        if isinstance(kind, types):
            return rank
    raise TypeError(f"a column of type {kind.simpleString()} has no value type")


def rank_of(value) -> int:
    value = plain(value)
    for rank, types in ((BOOL, bool), (INT, int), (FLOAT, float), (STRING, str), (BYTES, (bytes, bytearray))):
        if isinstance(value, types):
            return rank
    if value is None:
        return NULL
    raise TypeError(f"{type(value).__name__} is no value type")


def negative_zero(c: Column) -> Column:
    return (c == 0) & (c.cast("string") == "-0.0")


def value(payload: Column | None, rank: int) -> Column:
    """The struct of a rank's payload."""
    members = {"t": F.lit(rank)}
    if rank:
        members[PAYLOAD[rank]] = payload
    if rank == FLOAT:
        members["z"] = F.when(negative_zero(payload.cast("double")), 0).otherwise(1)
    return F.struct(*(members.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in KINDS.items()))


def literal(x) -> Column:
    return value(None if x is None else F.lit(plain(x)), rank_of(x))


def of_column(c: Column, kind: T.DataType, null_mode: str = "absent") -> Column:
    """A typed column as values; SQL NULL is an absent field or a stored null."""
    other = F.lit(None).cast(VALUE) if null_mode == "absent" else literal(None)
    return F.when(c.isNotNull(), value(payload(c, kind), rank_of_type(kind))).otherwise(other)
