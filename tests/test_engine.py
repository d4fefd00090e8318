"""The engine against DuckDB on the given tables, and against a naive model on rows with absent, null and mixed fields."""

import datetime
import operator
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import values
from tarnlake.functions.errors import Conflict
from tarnlake.functions.predicates import Atom, Tree, eq, ge, gt, is_not_null, is_null, le, lt, ne
from tarnlake.operators import mutations
from tarnlake.plans import queries
from tarnlake.plans.collection import Collection, InvalidArgument, dynamic_rows
from tarnlake.streaming.upsert import state, upsert

DIR = "/root/testdata/sf0.001"
ABSENT = object()
RANKS = [type(None), bool, int, float, str, bytes]


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr(tuple(map(clean, r))) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "events", "lineitem"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, DIR).toPandas()) == rows_of(con.sql(queries.ORACLE_SQL[name]).df())


def sort_key(v):
    if v is ABSENT:
        return (-1,)
    rank = RANKS.index(type(v))
    if rank == 3:
        return (rank, (1, 0) if v != v else (0, v), 0 if str(v) == "-0.0" else 1)
    return (rank, v) if rank else (rank,)


def holds(p, row):
    if isinstance(p, Tree):
        parts = [holds(x, row) for x in p.parts]
        return not parts[0] if p.op == "not" else all(parts) if p.op == "and" else any(parts)
    v = row.get(p.field, ABSENT)
    if v is ABSENT:
        return p.op == "ne"
    return {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}[p.op](sort_key(v), sort_key(p.value))


POOL = [None, False, True, -3, 0, 5, 2**40, -1.5, -0.0, 0.0, 2.5, float("inf"), float("nan"), "", "a", "é", b"", b"\xff"]


def random_predicate(rng, fields, pool, depth=2):
    if depth == 0 or rng.random() < 0.3:
        return Atom(rng.choice(["eq", "ne", "lt", "le", "gt", "ge"]), rng.choice(fields), rng.choice(pool))
    a, b = (random_predicate(rng, fields, pool, depth - 1) for _ in range(2))
    return rng.choice([a & b, a | b, ~a])


def test_dynamic_predicates_and_order_match_the_model(spark):
    rng = random.Random(7)
    data = {f"r{i}": {f: rng.choice(POOL) for f in ("x", "y") if rng.random() < 0.8} for i in range(60)}
    frames = [spark.range(1).select(F.lit(k).alias("id"), F.create_map(*(c for f, v in row.items() for c in (F.lit(f), values.literal(v)))).cast(f"map<string,{values.VALUE}>").alias("fields")) for k, row in data.items()]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    of = Collection(df.cache(), F.col("id"), fields="fields")
    tests = [random_predicate(rng, ["x", "y", "z"], POOL) for _ in range(60)]
    got = of.rows.select("id", *(of.where(p).alias(f"t{i}") for i, p in enumerate(tests))).collect()
    for r in got:
        for i, p in enumerate(tests):
            assert bool(r[f"t{i}"]) == holds(p, data[r["id"]]), (p, data[r["id"]])
    for down in (False, True):
        found = [r["id"] for r in of.query().sort("x", down).rows().collect()]
        model = sorted(data)
        model.sort(key=lambda k: sort_key(data[k].get("x", ABSENT)), reverse=down)
        if down:  # ties stay in rising order of id
            model = sorted(sorted(data), key=lambda k: sort_key(data[k].get("x", ABSENT)))
            groups = {}
            for k in model:
                groups.setdefault(sort_key(data[k].get("x", ABSENT)), []).append(k)
            model = [k for g in reversed(list(groups.values())) for k in g]
        assert found == model


@pytest.mark.parametrize("mode", ["absent", "stored"])
def test_typed_predicates_match_the_model(spark, mode):
    rng = random.Random(3)
    data = [(i, rng.choice([None, -2, 0, 3, 9]), rng.choice([None, -1.5, 0.0, -0.0, 4.0, float("nan")]), rng.choice([None, "a", "b", "ü"])) for i in range(40)]
    df = spark.createDataFrame(data, "k long, i long, f double, s string")
    of = Collection(df, F.col("k").cast("string"), mode)
    pool = [None, True, 0, 3, 4.0, 0.5, 0.0, -0.0, "a", "c", b"q"]
    tests = [random_predicate(rng, ["i", "f", "s", "none"], pool) for _ in range(80)]
    for r in of.rows.select("*", *(of.where(p).alias(f"t{n}") for n, p in enumerate(tests))).collect():
        row = {c: r[c] for c in ("i", "f", "s") if r[c] is not None or mode == "stored"}
        for n, p in enumerate(tests):
            assert bool(r[f"t{n}"]) == holds(p, row), (p, row)


def test_null_tests_differ_for_absent_and_stored_null(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, v string")
    for mode, null, other in (("absent", [], ["a", "b"]), ("stored", ["a"], ["b"])):
        of = Collection(df, F.col("id"), mode)
        for p, want in ((is_null("v"), null), (is_not_null("v"), other)):
            assert sorted(r["id"] for r in of.query().filter(p).rows().collect()) == want


def test_terminals_exclude_each_other(spark):
    q = Collection(spark.range(3), F.col("id").cast("string")).query()
    for bad in (lambda: q.aggregate("count").rows(), lambda: q.project().rows(), lambda: q.project("id").aggregate("count").result(), q.result):
        with pytest.raises(InvalidArgument):
            bad()


def test_filter_reaches_the_scan_and_limit_is_top_k(spark):
    plan = queries.flagship(spark, DIR)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(o_totalprice,250000.0)" in plan


def test_streamed_changes_fold_to_the_newest(spark, tmp_path):
    rows = queries.changes(spark, DIR)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", "event_id", "deleted", "event_type", "value").awaitTermination(120)
    got = state(spark, str(tmp_path / "out"), "user_id", "event_id", "deleted", "event_type", "value").toPandas()
    assert rows_of(got) == rows_of(queries.lww_merge(spark, DIR).toPandas())


def test_repeated_keys_need_an_order(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, v long")
    twice = spark.createDataFrame([(1, 11, False, 1), (1, 12, False, 2), (4, 40, False, 1), (2, None, True, 5)], "k long, v long, deleted boolean, step int")
    assert sorted(map(tuple, mutations.overlaid(base, twice, "k", order="step").collect())) == [(1, 12), (3, 30), (4, 40)]
    with pytest.raises(Exception, match="several writes"):
        mutations.overlaid(base, twice.drop("step"), "k").collect()
    after, conflicts = mutations.compare_and_set(base, twice.drop("deleted").withColumnRenamed("v", "to"), "k", F.col("v") > 10, {"v": F.col("to")}, order="step")
    assert sorted(map(tuple, after.collect())) == [(1, 10), (2, None), (3, 30)]
    assert sorted(map(tuple, conflicts.collect())) == [(1, "ExpectedFieldMismatch"), (4, "ExpectedFieldMismatch")]
    with pytest.raises(Conflict) as got:
        mutations.require_none(conflicts, "t", "k")
    assert (got.value.collection, got.value.id, got.value.reason) == ("t", "1", "ExpectedFieldMismatch")


def test_lookups_reach_the_scan_without_a_shuffle(spark):
    of = queries.orders(spark, DIR)
    plan = of.get("7")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan and [r.o_orderkey for r in of.get("7").collect()] == [7]
    assert all(of.get(x).count() == 0 for x in ("07", "-0", "x", "", "9" * 30))
    assert "Exchange" not in of.find("o_custkey", "eq", 5)._jdf.queryExecution().executedPlan().toString()
    after = queries.cas(spark, DIR)[0]
    assert "SortMergeJoin" not in after._jdf.queryExecution().executedPlan().toString()


def test_dates_and_decimals(spark):
    day = datetime.date
    rows = spark.createDataFrame([(1, day(2020, 1, 1), Decimal("1.50"), datetime.datetime(2020, 1, 1, 12)), (2, day(2020, 1, 2), Decimal("-2.25"), datetime.datetime(2020, 1, 2)), (3, None, None, None)], "k long, d date, n decimal(10,2), t timestamp_ntz")
    of = Collection(rows, F.col("k").cast("string"))
    found = lambda p: [r.k for r in of.query().filter(p).sort("k").rows().collect()]
    noon = datetime.datetime(2020, 1, 1, 12)
    assert found(le("d", noon)) == [1] and found(lt("d", noon)) == [1] and found(ge("d", noon)) == [2] and found(eq("d", noon)) == [] and found(ne("d", noon)) == [1, 2, 3]
    assert found(lt("d", day(2020, 1, 2))) == [1] and found(eq("d", day(2020, 1, 2))) == [2]
    assert found(gt("t", day(2020, 1, 1))) == [1, 2] and found(eq("t", noon)) == [1] and found(gt("n", 0.0)) == [1] and found(lt("d", 1.5)) == [1, 2]
    assert of.query().aggregate("max", "d").result().first()[0] == values.plain(day(2020, 1, 2))
    dynamic = Collection(dynamic_rows(rows, of.id, ["d", "n", "t"]), F.col("id"), fields="fields")
    assert [r["id"] for r in dynamic.query().filter(ge("t", noon) & lt("n", 0.0)).rows().collect()] == ["2"]


def test_explain_names_bounds_and_directions(spark):
    q = queries.orders(spark, DIR).query().filter(ge("o_totalprice", 5.0) & ~eq("o_orderstatus", "F")).sort("o_custkey", True).offset(3).limit(2)
    assert q.explain().split("\n") == ["Limit 2", "  Offset 3", "    Sort o_custkey desc", "      Filter o_totalprice >= 5.0 AND (NOT (o_orderstatus = 'F'))", "        FullScan"]


def test_tasks_of_large_logs_and_updates_hold_bounded_rows(spark, monkeypatch):
    from tarnlake.operators import log, mutations
    from tarnlake.sources import scratch

    for of in (log, mutations, scratch):
        monkeypatch.setattr(of, "parts", lambda df, *_, real=scratch.parts: real(df, 100))
    most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    rows = spark.range(3000).select("id", F.struct(F.col("id").alias("a")).alias("at"), F.lit(False).alias("deleted"), F.col("id").cast("string").alias("v"))
    writes = rows.unionByName(rows.where("id = 7").crossJoin(spark.range(2000).select(F.col("id").alias("k"))).select("id", F.struct((F.col("k") + 10).alias("a")).alias("at"), "deleted", F.col("k").cast("string").alias("v")))
    got = log.newest(writes, "id", "at", "deleted", "v")
    assert most(got) < 250 and got.count() == 3000
    assert {r.id: r.v for r in got.collect()} == {i: "1999" if i == 7 else str(i) for i in range(3000)}
    joined, lacking = mutations.split(rows, mutations.resolved(spark.range(1000, 4000), "id", None), "id")
    assert most(joined) < 250 and joined.where("_wanted").count() == 2000 and lacking.count() == 1000
