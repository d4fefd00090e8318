"""Updates of dynamic rows (an id and a map from field names to values): set, remove and increment fields under a condition.

Patches apply in the order given, each to what the one before it left. An increment needs a present number of its own
type: ints wrap at 64 bits, floats add. A row that one of its increments does not suit is left as it was and reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import InvalidArgument
from ..functions.values import FLOAT, INT, VALUE, literal, rank_of, value
from .mutations import resolved, split, wrapped

#: A patch: from the fields to the new fields and whether it suits them.
Patch = Callable[[Column], tuple[Column, Column]]


def put_field(name: str, x) -> Patch:
    """x: a Python value, or a column of values."""
    new = x if isinstance(x, Column) else literal(x)
    return lambda fields: (F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), new.cast(VALUE))), F.lit(True))


def drop_field(name: str) -> Patch:
    return lambda fields: (F.map_filter(fields, lambda k, _: k != name), F.lit(True))


def add_to_field(name: str, by: int | float) -> Patch:
    rank = rank_of(by)
    if rank not in (INT, FLOAT):
        raise InvalidArgument("an increment is a number")

    def patch(fields: Column) -> tuple[Column, Column]:
        old = fields[name]
        new = value(wrapped(old["i"], F.lit(by)), INT) if rank == INT else value(old["f"] + F.lit(by), FLOAT)
        suits = F.coalesce(old["t"] == rank, F.lit(False))
        return F.when(suits, put_field(name, new)(fields)[0]).otherwise(fields), suits

    return patch


def same(a: Column, b: Column) -> Column:
    """Both present, of one type and equal as numbers are: NaN equals nothing, -0.0 equals 0.0."""
    floats = (a["f"] == b["f"]) & ~F.isnan(a["f"])
    return F.coalesce(F.when(a["t"] == FLOAT, (b["t"] == FLOAT) & floats).otherwise(a == b), F.lit(False))


def same_fields(a: Column, b: Column) -> Column:
    """The same fields with the same values, whatever their order."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.map_keys(a), lambda k: same(a[k], b[k])), F.lit(False))


def update(base: DataFrame, wanted: DataFrame, key: str, expected: Column, patches: list[Patch], fields: str = "fields", absent_ok: bool = False, mismatch: str = "ExpectedFieldMismatch", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """base (key, fields) after the update, and the keys refused with the reason.

    wanted has a row for each key to update (the last by `order`), with what `expected` refers to. A key that base lacks
    starts with no field if absent_ok, else it is refused like one whose condition fails. Rows left without a field are gone.
    """
    wanted = resolved(wanted, key, order)
    joined, lacking = split(base, wanted, key)
    none = F.create_map().cast(f"map<string,{VALUE}>")
    joined = joined.withColumn("_there", F.lit(True)).unionByName(lacking.select("*", none.alias(fields), F.lit(True).alias("_wanted"), F.lit(False).alias("_there")), allowMissingColumns=True)
    staged = joined.withColumn("_old", F.coalesce(fields, none)).withColumn("_new", F.col("_old")).withColumn("_suits", F.lit(True))
    for patch in patches:
        new, suits = patch(F.col("_new"))
        staged = staged.withColumn("_suits", F.col("_suits") & suits).withColumn("_new", new)
    met = F.when(F.col("_there"), F.coalesce(expected, F.lit(False))).otherwise(F.lit(absent_ok))
    staged = staged.withColumn("_reason", F.when(F.col("_wanted"), F.when(~met, F.lit(mismatch)).when(~F.col("_suits"), "InvalidArgument")))
    after = staged.select(key, F.when(F.col("_wanted") & F.col("_reason").isNull(), F.col("_new")).otherwise(F.col("_old")).alias(fields)).where(F.size(fields) > 0)
    return after, staged.where("_reason is not null").select(key, F.col("_reason").alias("reason"))
