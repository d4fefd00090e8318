"""Predicates over fields, compiled to Catalyst expressions.

A comparison with an absent field is false, but for `ne`, which is true; NOT is the plain complement. Negation is
moved to the comparisons, so that no SQL NULL meets a NOT and the parquet scan gets plain bounds.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument
from .values import FLOAT, NULL, TIMES, literal, negative_zero, payload, plain, rank_of, rank_of_type

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
SYMBOLS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
INVERSE = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}


class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return Tree("and", (self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Tree("or", (self, other))

    def __invert__(self) -> "Predicate":
        return Tree("not", (self,))


@dataclass(frozen=True)
class Atom(Predicate):
    op: str
    field: str
    value: object


@dataclass(frozen=True)
class Tree(Predicate):
    op: str
    parts: tuple[Predicate, ...]


def _atom(op: str):
    return lambda field, value: Atom(op, field, value)


eq, ne, lt, le, gt, ge = map(_atom, COMPARE)


def between(field: str, low, high) -> Predicate:
    return ge(field, low) & le(field, high)


def isin(field: str, values: list) -> Predicate:
    if not values or len({rank_of(v) for v in values}) > 1:
        raise InvalidArgument("IN takes one or more values of one type")
    return reduce(operator.or_, (eq(field, v) for v in values))


def is_null(field: str) -> Predicate:
    """A stored null; an absent field is none."""
    return eq(field, None)


def is_not_null(field: str) -> Predicate:
    """Anything but a stored null, absent fields included."""
    return ne(field, None)


def is_absent(field: str) -> Predicate:
    """No such field, as an extension; a stored null is there."""
    return Atom("absent", field, None)


def described(p: Predicate) -> str:
    if isinstance(p, Atom):
        return f"{p.field} is absent" if p.op == "absent" else f"{p.field} {SYMBOLS[p.op]} {p.value!r}"
    if p.op == "not":
        return f"NOT ({described(p.parts[0])})"
    return f" {p.op.upper()} ".join(f"({described(x)})" if isinstance(x, Tree) else described(x) for x in p.parts)


def compared(c: Column, op: str, value, kind: T.DataType) -> Column:
    """A typed column against a value of its rank, as a bound that the scan can use. -0.0 is below 0.0."""
    value = plain(value)
    if isinstance(kind, T.DateType):
        day, rest = divmod(value, 86_400_000_000)
        if rest and op in ("eq", "ne"):
            return c.isNotNull() & F.lit(op == "ne")
        return COMPARE[{"lt": "le", "ge": "gt"}.get(op, op) if rest else op](c, F.date_from_unix_date(F.lit(day)))
    if isinstance(kind, TIMES):
        return COMPARE[op](c, F.timestamp_micros(F.lit(value)).cast(kind))
    if rank_of_type(kind) != FLOAT or isinstance(kind, T.DecimalType) or value != 0:
        return COMPARE[op](payload(c, kind), F.lit(value))
    below = str(float(value)) == "-0.0"
    mine = negative_zero(c.cast("double"))
    mine = mine if below else ~mine
    return {
        "eq": (c == 0) & mine,
        "ne": (c != 0) | ~mine,
        "lt": c < 0 if below else (c <= 0) & ((c < 0) | ~mine),
        "le": (c <= 0) & ((c < 0) | mine) if below else c <= 0,
        "gt": (c >= 0) & ((c > 0) | ~mine) if below else c > 0,
        "ge": c >= 0 if below else (c >= 0) & ((c > 0) | mine),
    }[op]


def compiled(p: Predicate, atom, negated: bool = False) -> Column:
    """atom: a function from (op, field, value, negated) to a column that is never true for what must not match."""
    if isinstance(p, Atom):
        return atom(p.op, p.field, p.value, negated)
    if p.op == "not":
        return compiled(p.parts[0], atom, not negated)
    parts = [compiled(x, atom, negated) for x in p.parts]
    return reduce(operator.and_ if (p.op == "and") != negated else operator.or_, parts)


def typed(p: Predicate, schema: T.StructType, null_mode: str = "absent", coerce: bool = False) -> Column:
    """Over plain columns. coerce: let ints and floats compare by number instead of by type."""
    kinds = {f.name: f.dataType for f in schema.fields}

    def atom(op: str, field: str, value, negated: bool) -> Column:
        if op == "absent":
            if field not in kinds or null_mode != "absent":
                return F.lit((field not in kinds) != negated)
            return F.col(f"`{field}`").isNotNull() if negated else F.col(f"`{field}`").isNull()
        absent = (op == "ne") != negated
        if field not in kinds:
            return F.lit(absent)
        c, mine, rank = F.col(f"`{field}`"), rank_of_type(kinds[field]), rank_of(value)
        if coerce and {mine, rank} == {2, 3}:
            value, rank = (float(value), mine) if mine == 3 else (value, mine)
        of_null = absent if null_mode == "absent" else COMPARE[op](NULL, rank) != negated
        if mine != rank:
            present = COMPARE[op](mine, rank) != negated
            if present == of_null:
                return F.lit(present)
            return c.isNotNull() if present else c.isNull()
        test = compared(c, INVERSE[op] if negated else op, value, kinds[field])
        return test | c.isNull() if of_null else test

    return compiled(p, atom)


def dynamic(p: Predicate, fields: str = "fields") -> Column:
    """Over a map from field name to value."""

    def atom(op: str, field: str, value, negated: bool) -> Column:
        v = F.col(fields)[field]
        if op == "absent":
            return v.isNotNull() if negated else v.isNull()
        test = COMPARE[INVERSE[op] if negated else op](v, literal(value))
        return test | v.isNull() if (op == "ne") != negated else test

    return compiled(p, atom)
