"""Collections and their queries: filter, then sort by one field, then offset and limit, then fields or one aggregate.

The order of calls does not matter: a filter given after limit still comes before it. Sorting puts absent fields
first in rising and last in falling order and breaks ties by rising id, compared as text. With several sorts or
limits the first one given counts, unless `strict` is off, which sorts by all of them in turn.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates, values
from ..functions.errors import InvalidArgument
from ..operators import aggregates
from ..operators.order import placed
from ..sources.scratch import small


@dataclass(frozen=True)
class Collection:
    """Rows with an id. With `fields` set the rows are dynamic: that column maps field names to values.

    key: the column that the id is the text of, if there is one; lookups then compare it, so that they reach the scan.
    """

    rows: DataFrame
    id: Column
    null_mode: str = "absent"
    fields: str | None = None
    coerce: bool = False
    strict: bool = True
    key: str | None = None

    def query(self) -> "Query":
        return Query(self)

    def get(self, key: str) -> DataFrame:
        if not self.key or not isinstance(self.rows.schema[self.key].dataType, T.IntegralType):
            return self.rows.where(self.id == key)
        if not re.fullmatch(r"0|-?[1-9]\d{0,18}", key) or not -(1 << 63) <= int(key) < 1 << 63:
            return self.rows.where(F.lit(False))
        return self.rows.where(F.col(self.key) == int(key))

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (`id`), each once; ids without a row are dropped."""
        ids = ids.select(F.col("id").alias("_id")).distinct()
        if not self.key:
            return self.rows.join(small(ids), self.id == F.col("_id"), "left_semi")
        typed = F.expr(f"try_cast(_id as {self.rows.schema[self.key].dataType.simpleString()})").alias("_key")
        ids = ids.select("_id", typed).where(F.col("_key").cast("string") == F.col("_id"))
        return self.rows.join(small(ids.select("_key")), F.col(self.key) == F.col("_key"), "left_semi")

    def scan(self) -> DataFrame:
        return self.rows.orderBy(self.id)

    def where(self, p: predicates.Predicate) -> Column:
        return predicates.dynamic(p, self.fields) if self.fields else predicates.typed(p, self.rows.schema, self.null_mode, self.coerce)

    def find(self, name: str, op: str, value, high=None) -> DataFrame:
        """Ids of the rows whose field compares so with the value (op between: and with high)."""
        p = predicates.between(name, value, high) if op == "between" else predicates.Atom(op, name, value)
        return self.rows.where(self.where(p)).select(self.id.alias("id"))

    def find_composite(self, bounds: list[tuple[str, object, object]]) -> DataFrame:
        """Ids whose fields lie within all (field, low, high); a bound of `...` is open. Only rows that have all the fields."""
        atoms = [p for name, low, high in bounds for p in ([predicates.ge(name, low)] if low is not ... else []) + ([predicates.le(name, high)] if high is not ... else [])]
        present = reduce(operator.and_, (self.value(name).isNotNull() for name, _, _ in bounds))
        rows = self.rows.where(present)
        return (rows.where(self.where(reduce(operator.and_, atoms))) if atoms else rows).select(self.id.alias("id"))

    def sort_keys(self, name: str, down: bool) -> list[Column]:
        """Absent fields first in rising order; -0.0 is below 0.0."""
        v = self.value(name)
        keys = [v]
        if not self.fields and isinstance(self.rows.schema[name].dataType, (T.DoubleType, T.FloatType)):
            keys.append(~values.negative_zero(v.cast("double")))
        return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]

    def value(self, name: str) -> Column:
        return F.col(self.fields)[name] if self.fields else F.col(f"`{name}`")


@dataclass(frozen=True)
class Query:
    of: Collection
    filters: tuple = ()
    sorts: tuple = ()
    limits: tuple = ()
    skip: int = 0
    projection: tuple | None = None
    aggregation: tuple | None = None

    def filter(self, p: predicates.Predicate) -> "Query":
        return replace(self, filters=(*self.filters, p))

    def sort(self, name: str, descending: bool = False) -> "Query":
        return replace(self, sorts=(*self.sorts, (name, descending)))

    def limit(self, n: int) -> "Query":
        return replace(self, limits=(*self.limits, n))

    def offset(self, n: int) -> "Query":
        return replace(self, skip=n)

    def project(self, *names: str) -> "Query":
        return replace(self, projection=names)

    def aggregate(self, kind: str, name: str | None = None) -> "Query":
        return replace(self, aggregation=(kind, name))

    def selected(self, skip: bool = True) -> DataFrame:
        """The rows after filter, sort, offset and limit."""
        out = self.of.rows
        if self.filters:
            out = out.where(self.of.where(reduce(operator.and_, self.filters)))
        if self.sorts:
            by = [k for n, down in (self.sorts[:1] if self.of.strict else self.sorts) if self.of.fields or n in self.of.rows.columns for k in self.of.sort_keys(n, down)]
            out = out.orderBy(*by, self.of.id.asc())
        if self.limits:
            n = self.limits[0]
            out = out.offset(self.skip).limit(n) if skip and self.skip else out.limit(n if skip else n + self.skip)
        elif self.skip and skip:
            out = placed(out, *out.columns).where(F.col("place") > self.skip).drop("place")
        return out

    def rows(self) -> DataFrame:
        """The selected rows, or their projected fields after the id."""
        if self.aggregation:
            raise InvalidArgument("an aggregation has no rows")
        if self.projection is None:
            return self.selected()
        if not self.projection:
            raise InvalidArgument("a projection needs a field")
        out = self.selected()
        if self.of.fields:
            wanted = list(self.projection)
            return out.select(self.of.id.alias("id"), F.map_filter(self.of.fields, lambda k, _: k.isin(wanted)).alias(self.of.fields))
        return out.select(self.of.id.alias("id"), *(F.col(f"`{n}`") for n in self.projection if n in out.columns))

    def entries(self) -> DataFrame:
        """(id, entries): the projected fields of dynamic rows as an array, in the order asked for and as often as asked for; absent ones are left out."""
        if not self.projection or not self.of.fields or self.aggregation:
            raise InvalidArgument("entries are the projected fields of dynamic rows")
        asked = F.array(*(F.struct(F.lit(n).alias("field"), F.col(self.of.fields)[n].alias("value")) for n in self.projection))
        return self.selected().select(self.of.id.alias("id"), F.filter(asked, lambda e: e["value"].isNotNull()).alias("entries"))

    def result(self) -> DataFrame:
        """One row with `result`. Rows beyond an offset are not skipped, but the limit grows by it."""
        if self.projection is not None:
            raise InvalidArgument("a projection can't be aggregated")
        if not self.aggregation:
            raise InvalidArgument("no aggregation is set")
        kind, name = self.aggregation
        out = self.selected(skip=not self.of.strict)
        how = aggregates.dynamic(kind, name, self.of.fields) if self.of.fields else aggregates.typed(kind, name, out.schema)
        return out.agg(how.alias("result"))

    def explain(self) -> str:
        """What is asked for, a node a line; DataFrame.explain shows what Spark makes of it."""
        sorts = self.sorts[:1] if self.of.strict else self.sorts
        nodes = ["FullScan"] + [f"Filter {predicates.described(p)}" for p in self.filters]
        nodes += [f"Sort {', '.join(f'{n} {_way(d)}' for n, d in sorts)}"] if sorts else []
        nodes += [f"Offset {self.skip}"] if self.skip else []
        nodes += [f"Limit {n}" for n in self.limits[:1]]
        nodes += [f"Project {', '.join(self.projection)}"] if self.projection else []
        nodes += [f"Aggregate {self.aggregation[0]}({self.aggregation[1] or '*'})"] if self.aggregation else []
        return "\n".join("  " * k + x for k, x in enumerate(reversed(nodes)))


def _way(down: bool) -> str:
    return "desc" if down else "asc"


def union_ids(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def assembled(triples: DataFrame) -> DataFrame:
    """(id, field, value) rows as (id, fields); a field written twice must have been resolved before."""
    return triples.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def dynamic_rows(rows: DataFrame, id_: Column, names: list[str], null_mode: str = "absent") -> DataFrame:
    """Typed rows as (id, fields), absent fields left out, rows without any field dropped."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(values.of_column(F.col(n), kinds[n], null_mode) for n in names)))
    return rows.select(id_.alias("id"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("fields")).where(F.size("fields") > 0)
