"""Small collections with known answers: absent fields, aggregates, ties, composite lookups, tasks and their events, logs."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import values
from tarnlake.functions.predicates import eq, ge, gt, is_not_null, is_null, isin, lt, ne
from tarnlake.operators import patches
from tarnlake.plans.collection import Collection, InvalidArgument

INF, NAN = float("inf"), float("nan")
# fixed values
TASKS = {
    "t1": {"title": "A", "status": "todo", "priority": 2, "assignee": "tobias", "project_id": "p1", "estimate": 3},
    "t2": {"title": "B", "status": "todo", "priority": 5, "assignee": "anna", "project_id": "p1", "estimate": 8},
    "t3": {"title": "C", "status": "doing", "priority": 3, "assignee": "tobias", "project_id": "p1", "estimate": 2},
    "t4": {"title": "D", "status": "done", "priority": 9, "assignee": "max", "project_id": "p1", "estimate": 1},
    "t5": {"title": "E", "status": "todo", "priority": 1, "project_id": "p2", "estimate": 4},
    "t6": {"title": "F", "status": "todo", "priority": 7, "project_id": "p1", "estimate": 6},
}


def value_of(x):
    rank = values.rank_of(x)
    return {k: None for k in values.KINDS} | {"t": rank} | ({values.PAYLOAD[rank]: x} if rank else {}) | ({"z": 0 if str(x) == "-0.0" else 1} if rank == values.FLOAT else {})


def collection(spark, rows):
    data = [(k, {f: value_of(v) for f, v in row.items()}) for k, row in rows.items()]
    return Collection(spark.createDataFrame(data, f"id string, fields map<string,{values.VALUE}>"), F.col("id"), fields="fields")


def ids(df):
    return [r["id"] for r in df.collect()]


def number(of, kind, field=None):
    out = of.query().aggregate(kind, field).result().first()["result"]
    return out if kind == "count" or out is None else out[values.PAYLOAD[out["t"]]]


def test_absent_fields_and_projection(spark):
    of = collection(spark, {"u1": {"age": 30, "name": "u1"}, "u2": {"age": 40, "nick": None}, "u3": {"name": "u3"}})
    assert sorted(ids(of.query().filter(~eq("age", 30)).rows())) == sorted(ids(of.query().filter(ne("age", 30)).rows())) == ["u2", "u3"]
    got = {r["id"]: [(e["field"], e["value"]["t"]) for e in r["entries"]] for r in of.query().project("nick", "age", "none", "age").entries().collect()}
    assert got == {"u1": [("age", 2), ("age", 2)], "u2": [("nick", 0), ("age", 2), ("age", 2)], "u3": []}
    for bad in (of.query().entries, of.query().project().entries):
        with pytest.raises(InvalidArgument):
            bad()


# fixed values, and their answers
@pytest.mark.parametrize(
    "column, want",
    [
        ([10, None, ..., "oops"], {"sum": 10, "avg": 10.0, "min": 10, "max": 10, "count": 4}),
        ([2**63 - 1, 2**63 - 1], {"sum": 2**63 - 1}),
        ([-(2**63), -(2**63)], {"sum": -(2**63)}),
        ([10, 5.5, 20], {"sum": 35.5, "min": 5.5, "max": 20.0}),
        ([NAN, INF, 7], {"sum": 7, "count": 3}),
        ([NAN, -INF], {"sum": None, "min": None, "avg": None, "count": 2}),
    ],
)
def test_aggregates(spark, column, want):
    of = collection(spark, {f"u{i}": {"name": "n"} | ({} if v is ... else {"v": v}) for i, v in enumerate(column)})
    for kind, x in want.items():
        got = number(of, kind, "v")
        assert got == x and type(got) is type(x)


# fixed ids and their order
def test_ties_stay_in_order_of_id(spark):
    of = collection(spark, {k: {"age": 50} for k in ("a1", "a2", "a10", "a11", "a3")} | {"b1": {"age": 40}, "b2": {"age": 60}})
    assert ids(of.query().sort("age").rows()) == ["b1", "a1", "a10", "a11", "a2", "a3", "b2"]
    assert ids(of.query().sort("age", True).rows()) == ["b2", "a1", "a10", "a11", "a2", "a3", "b1"]


def test_composite_lookups_need_all_fields(spark):
    of = collection(spark, {"u1": {"team": "T1", "score": 5}, "u2": {"team": "T1", "score": None}, "u3": {"team": "T1"}, "u4": {"team": "T2", "score": 5}, "u5": {"team": "T1", "score": "5"}})
    assert sorted(ids(of.find_composite([("team", "T1", "T1"), ("score", None, None)]))) == ["u2"]
    assert sorted(ids(of.find_composite([("team", "T1", "T1"), ("score", ..., ...)]))) == ["u1", "u2", "u5"]
    assert sorted(ids(of.find_composite([("team", "T1", "T1"), ("score", 5, "4")]))) == ["u1"]


TODO, P1 = eq("status", "todo"), eq("project_id", "p1")


@pytest.mark.parametrize(
    "p, want",
    [
        (P1 & TODO, "t1 t2 t6"),
        (TODO, "t1 t2 t5 t6"),
        (ge("priority", 2), "t1 t2 t3 t4 t6"),
        (eq("assignee", "tobias"), "t1 t3"),
        (lt("priority", 5) & gt("priority", 1), "t1 t3"),
        (ne("assignee", "x"), "t1 t2 t3 t4 t5 t6"),
        (eq("status", "done") & ge("estimate", 8), ""),
        (isin("status", ["doing", "done"]), "t3 t4"),
        (~isin("assignee", ["tobias", "anna"]), "t4 t5 t6"),
        (~(TODO | gt("priority", 8)), "t3"),
        (is_null("assignee"), ""),
        (is_not_null("assignee"), "t1 t2 t3 t4 t5 t6"),
    ],
)
def test_tasks(spark, p, want):
    assert sorted(ids(collection(spark, TASKS).query().filter(p).rows())) == want.split()


def test_tasks_in_pages_and_events_by_time(spark):
    of = collection(spark, TASKS)
    assert ids(of.query().filter(P1).sort("priority").limit(2).offset(2).rows()) == ["t2", "t6"]
    assert number(of, "count") == 6 and number(of, "sum", "estimate") == 24 and number(of, "max", "title") is None
    events = collection(spark, {"e1": {"task_id": "t1", "created_at": 10}, "e2": {"task_id": "t1", "created_at": 30}, "e3": {"task_id": "t2", "created_at": 20}})
    assert ids(events.query().filter(eq("task_id", "t1")).sort("created_at", True).rows()) == ["e2", "e1"]
    assert ids(collection(spark, {"n": {"x": 1}}).query().filter(eq("x", 2)).rows()) == []


def test_conditions_and_patches(spark):
    base = collection(spark, {"a": {"age": 2**63 - 1, "x": NAN}, "b": {"age": 1.5, "x": -0.0}, "c": {"name": "c"}}).rows
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")

    def run(expected, steps, **options):
        after, refused = patches.update(base, wanted, "id", expected, steps, **options)
        short = lambda v: v[values.PAYLOAD[v["t"]]] if v["t"] else None
        return {r["id"]: {k: short(v) for k, v in r["fields"].items() if k != "x"} for r in after.collect()}, {r["id"]: r["reason"] for r in refused.collect()}

    rows, refused = run(F.lit(True), [patches.add_to_field("age", 1)])
    assert rows == {"a": {"age": -(2**63)}, "b": {"age": 1.5}, "c": {"name": "c"}}
    assert refused == {"b": "InvalidArgument", "c": "InvalidArgument", "d": "ExpectedFieldMismatch"}
    rows, refused = run(F.lit(True), [patches.put_field("n", 1), patches.add_to_field("n", 4), patches.drop_field("age")], absent_ok=True)
    assert rows == {"a": {"n": 5}, "b": {"n": 5}, "c": {"n": 5, "name": "c"}, "d": {"n": 5}} and not refused
    rows, refused = run(F.lit(True), [patches.drop_field("name")])
    assert set(rows) == {"a", "b"}  # a row without a field is gone
    x = F.col("fields")["x"]
    assert run(patches.same(x, values.literal(0.0)), [])[1].keys() == {"a", "c", "d"}
    assert run(patches.same(x, values.literal(NAN)), [])[1].keys() == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        patches.add_to_field("n", "1")
