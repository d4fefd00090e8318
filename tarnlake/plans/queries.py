"""The queries of the engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.predicates import between, eq, ge, gt, is_absent, is_not_null, is_null, isin, le, lt, ne
from ..operators import aggregates, log, mutations
from ..operators.order import placed
from . import stored
from .collection import Collection, assembled, dynamic_rows, union_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(stored.QUERIES)
ORACLE_SQL: dict[str, str] = dict(stored.ORACLE_SQL)
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
ROW = "o_orderkey, o_totalprice, o_orderstatus"


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, **options) -> Collection:
    return Collection(read(spark, sf_dir, "orders").select(*ORDER), F.col("o_orderkey").cast("string"), key="o_orderkey", **options)


def sparse(spark: SparkSession, sf_dir: str, null_mode: str = "absent") -> Collection:
    """Orders whose lowest priority is an absent field or a stored null."""
    rows = read(spark, sf_dir, "orders").select(*ORDER).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return Collection(rows, F.col("o_orderkey").cast("string"), null_mode)


def documents_of(spark: SparkSession, sf_dir: str) -> Collection:
    """The same as dynamic rows."""
    of = sparse(spark, sf_dir)
    return Collection(dynamic_rows(of.rows, of.id, ["o_custkey", "o_totalprice", "o_orderpriority"]), F.col("id"), fields="fields")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest orders of at least 250,000 that are not finished."""
    return orders(spark, sf_dir).query().filter(ge("o_totalprice", 250000.0) & ne("o_orderstatus", "F")).sort("o_totalprice", True).limit(10).rows()


query(f"select {', '.join(ORDER)} from orders where o_totalprice >= 250000 and o_orderstatus <> 'F' order by o_totalprice desc, o_orderkey::varchar limit 10", "flagship")(flagship)

LOW = "nullif(o_orderpriority, '5-LOW')"
FILTERS = {
    "pred_eq": (eq("o_orderstatus", "F"), "o_orderstatus = 'F'"),
    "pred_ne": (ne("o_orderstatus", "F"), "o_orderstatus <> 'F'"),
    "pred_lt": (lt("o_totalprice", 100000.0), "o_totalprice < 100000"),
    "pred_le": (le("o_custkey", 500), "o_custkey <= 500"),
    "pred_gt": (gt("o_totalprice", 300000.0), "o_totalprice > 300000"),
    "pred_ge": (ge("o_custkey", 500), "o_custkey >= 500"),
    "pred_and": (gt("o_totalprice", 1e5) & eq("o_orderstatus", "O"), "o_totalprice > 100000 and o_orderstatus = 'O'"),
    "pred_or": (gt("o_totalprice", 3e5) | eq("o_orderstatus", "P"), "o_totalprice > 300000 or o_orderstatus = 'P'"),
    "pred_not": (~eq("o_orderstatus", "O"), "o_orderstatus <> 'O'"),
    "pred_not_range": (~(gt("o_totalprice", 1e5) & lt("o_totalprice", 2e5)), "o_totalprice <= 100000 or o_totalprice >= 200000"),
    "pred_nested": (~((eq("o_orderstatus", "O") | lt("o_custkey", 300)) & ~gt("o_totalprice", 2e5)), "not ((o_orderstatus = 'O' or o_custkey < 300) and o_totalprice <= 200000)"),
    "pred_between": (between("o_totalprice", 1e5, 1.5e5), "o_totalprice between 100000 and 150000"),
    "pred_in": (isin("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "pred_not_in": (~isin("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority not in ('1-URGENT', '2-HIGH')"),
    "pred_cross_type": (gt("o_totalprice", 10) & lt("o_custkey", "x"), "true"),
    "pred_contradiction": (gt("o_custkey", 5) & ge("o_custkey", 5) & ~eq("o_custkey", 6), "o_custkey > 5 and o_custkey <> 6"),
}
for _name, (_p, _sql) in FILTERS.items():
    query(f"select {ROW} from orders where {_sql}", _name)(lambda spark, sf_dir, p=_p: orders(spark, sf_dir).query().filter(p).rows().select(*ROW.split(", ")))

SPARSE = {
    "missing_ne": (ne("o_orderpriority", "1-URGENT"), f"{LOW} <> '1-URGENT' or {LOW} is null", "absent"),
    "missing_not_gt": (~gt("o_orderpriority", "2-HIGH"), f"{LOW} <= '2-HIGH' or {LOW} is null", "absent"),
    "missing_lt": (lt("o_orderpriority", "3"), f"{LOW} < '3'", "absent"),
    "missing_is_not_null": (is_not_null("o_orderpriority"), "true", "absent"),
    "missing_is_absent": (is_absent("o_orderpriority"), f"{LOW} is null", "absent"),
    "missing_is_not_absent": (~is_absent("o_orderpriority"), f"{LOW} is not null", "absent"),
    "null_is_null": (is_null("o_orderpriority"), f"{LOW} is null", "stored"),
    "null_is_not_null": (is_not_null("o_orderpriority"), f"{LOW} is not null", "stored"),
    "null_lt": (lt("o_orderpriority", "2"), f"{LOW} < '2' or {LOW} is null", "stored"),
    "null_not_lt": (~lt("o_orderpriority", "2"), f"{LOW} >= '2'", "stored"),
}
for _name, (_p, _sql, _mode) in SPARSE.items():
    query(f"select o_orderkey, {LOW} as o_orderpriority from orders where {_sql}", _name)(lambda spark, sf_dir, p=_p, mode=_mode: sparse(spark, sf_dir, mode).query().filter(p).rows().select("o_orderkey", "o_orderpriority"))
    if _mode == "absent":
        query(f"select o_orderkey::varchar as id from orders where {_sql}", f"dynamic_{_name}")(lambda spark, sf_dir, p=_p: documents_of(spark, sf_dir).query().filter(p).rows().select("id"))


for _name, _down, _field, _nulls in (("topk_asc", False, "o_totalprice", "asc nulls first"), ("topk_desc", True, "o_totalprice", "desc nulls last"), ("missing_sort_asc", False, "o_orderpriority", "asc nulls first"), ("missing_sort_desc", True, "o_orderpriority", "desc nulls last")):
    query(f"select o_orderkey, p as {_field} from (select o_orderkey, {LOW if _field == 'o_orderpriority' else _field} as p from orders) order by p {_nulls}, o_orderkey::varchar limit 100", _name)(lambda spark, sf_dir, f=_field, d=_down: sparse(spark, sf_dir).query().sort(f, d).limit(100).rows().select("o_orderkey", f))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey::varchar limit 20 offset 30")
def limit_offset(spark, sf_dir):
    return orders(spark, sf_dir).query().limit(20).offset(30).sort("o_totalprice", True).rows().select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 300000 or o_orderstatus = 'P' order by o_totalprice, o_orderkey::varchar limit 50")
def topk_or(spark, sf_dir):
    return orders(spark, sf_dir).query().limit(50).sort("o_totalprice").filter(gt("o_totalprice", 3e5) | eq("o_orderstatus", "P")).rows().select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_custkey from orders order by o_custkey, o_orderkey::varchar limit 40")
def sort_first_key_counts(spark, sf_dir):
    return orders(spark, sf_dir).query().sort("o_custkey").sort("o_totalprice").limit(40).limit(5).rows().select("o_orderkey", "o_custkey")


@query("select o_orderkey, o_custkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey::varchar limit 40")
def sort_several_keys(spark, sf_dir):
    return orders(spark, sf_dir, strict=False).query().sort("o_custkey").sort("o_totalprice", True).limit(40).rows().select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey::varchar as id, o_totalprice, o_orderstatus from orders")
def project_fields(spark, sf_dir):
    return orders(spark, sf_dir).query().project("o_totalprice", "missing", "o_orderstatus").rows()


@query(f"select {', '.join(ORDER)} from orders")
def project_star(spark, sf_dir):
    return orders(spark, sf_dir).query().rows()


@query(f"select o_orderkey::varchar as id, 1 + ({LOW} is not null)::int as n, o_totalprice, {LOW} as priority from orders")
def project_dynamic(spark, sf_dir):
    out = documents_of(spark, sf_dir).query().project("o_orderpriority", "o_totalprice").rows()
    return out.select("id", F.size("fields").alias("n"), F.col("fields")["o_totalprice"]["f"].alias("o_totalprice"), F.col("fields")["o_orderpriority"]["s"].alias("priority"))


def aggregate(name: str, build, sql: str, digits: int | None = None):
    r = f"round({sql.split(' from ')[0].removeprefix('select ')}, {digits}) as result from {sql.split(' from ', 1)[1]}" if digits is not None else sql.removeprefix("select ")
    query(f"select {r}", name)(lambda spark, sf_dir: build(spark, sf_dir).select((F.round("result", digits) if digits is not None else F.col("result")).alias("result")))


def over(kind: str, field: str | None = None, p=None):
    def build(spark, sf_dir):
        q = orders(spark, sf_dir).query().aggregate(kind, field)
        return (q.filter(p) if p else q).result()

    return build


aggregate("agg_count", over("count", None, gt("o_totalprice", 2e5)), "select count(*) as result from orders where o_totalprice > 200000")
aggregate("agg_sum_int", over("sum", "o_custkey"), "select sum(o_custkey)::bigint as result from orders")
aggregate("agg_sum_float", over("sum", "o_totalprice"), "select sum(o_totalprice) from orders", 2)
aggregate("agg_avg", over("avg", "o_custkey"), "select avg(o_custkey) from orders", 6)
aggregate("agg_min", over("min", "o_totalprice"), "select min(o_totalprice) as result from orders")
aggregate("agg_max", over("max", "o_custkey"), "select max(o_custkey) as result from orders")
aggregate("agg_empty_none", over("sum", "o_custkey", lt("o_custkey", -1)), "select sum(o_custkey)::bigint as result from orders where false")
aggregate("agg_text_none", over("max", "o_orderstatus"), "select null::double as result")


@query("select max(o_totalprice) as result from (select * from orders order by o_custkey, o_orderkey::varchar limit 25)")
def agg_over_topk(spark, sf_dir):
    return orders(spark, sf_dir).query().sort("o_custkey").limit(25).aggregate("max", "o_totalprice").result()


@query("select sum(o_custkey)::bigint as result from (select * from orders order by o_totalprice, o_orderkey::varchar limit 15)")
def agg_offset_widens_limit(spark, sf_dir):
    return orders(spark, sf_dir).query().sort("o_totalprice").limit(10).offset(5).aggregate("sum", "o_custkey").result()


@query("select least(sum(o_custkey::hugeint + 9000000000000000), 9223372036854775807)::bigint as result from orders")
def agg_sum_saturate(spark, sf_dir):
    rows = orders(spark, sf_dir).rows.withColumn("o_custkey", F.col("o_custkey") + 9000000000000000)
    return Collection(rows, F.col("o_orderkey").cast("string")).query().aggregate("sum", "o_custkey").result()


@query("select round(sum(case when o_orderkey % 3 <> 0 then o_totalprice end), 2) as result from orders")
def agg_skip_nonfinite(spark, sf_dir):
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("o_totalprice"))
    return Collection(orders(spark, sf_dir).rows.withColumn("o_totalprice", odd), F.col("o_orderkey").cast("string")).query().aggregate("sum", "o_totalprice").result().select(F.round("result", 2).alias("result"))


def mixed(spark, sf_dir) -> Collection:
    """Parts whose field is an int, a text, a float, a stored null or absent."""
    k = F.col("p_partkey") % 5
    v = F.when(k == 0, values.value(F.col("p_size").cast("long"), values.INT)).when(k == 1, values.value(F.col("p_brand"), values.STRING)).when(k == 2, values.value(F.col("p_retailprice"), values.FLOAT)).when(k == 3, values.literal(None))
    pair = F.map_filter(F.create_map(F.lit("v"), v, F.lit("key"), values.value(F.col("p_partkey"), values.INT)), lambda _, x: x.isNotNull())
    return Collection(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), pair.alias("fields")), F.col("id"), fields="fields")


@query("select id, row_number() over (order by k, i, f, s, id) as place from (select p_partkey::varchar as id, case p_partkey % 5 when 4 then 0 when 3 then 1 when 0 then 2 when 2 then 3 else 4 end as k, case when p_partkey % 5 = 0 then p_size end as i, case when p_partkey % 5 = 2 then p_retailprice end as f, case when p_partkey % 5 = 1 then p_brand end as s from part)")
def cross_type_order(spark, sf_dir):
    return placed(mixed(spark, sf_dir).query().sort("v").rows(), "id")


query(ORACLE_SQL["cross_type_order"], "cross_type_order_all")(cross_type_order)


@query("select p_partkey::varchar as id from part where p_partkey % 5 in (1, 2) or p_partkey % 5 = 0 and p_size > 20")
def cross_type_gt(spark, sf_dir):
    return mixed(spark, sf_dir).query().filter(gt("v", 20)).rows().select("id")


@query("select round(sum(case p_partkey % 5 when 0 then p_size when 2 then p_retailprice end), 2) as total, min(case p_partkey % 5 when 0 then p_size when 2 then p_retailprice end) as least, round(avg(case p_partkey % 5 when 0 then p_size when 2 then p_retailprice end), 6) as mean from part")
def agg_mixed_promotes(spark, sf_dir):
    one = lambda kind: aggregates.dynamic(kind, "v")["f"]
    return mixed(spark, sf_dir).rows.agg(F.round(one("sum"), 2).alias("total"), one("min").alias("least"), F.round(one("avg"), 6).alias("mean"))


for _name, _args, _sql in (("index_find_eq", ("o_custkey", "eq", 77), "o_custkey = 77"), ("index_find_range", ("o_totalprice", "ge", 4e5), "o_totalprice >= 400000"), ("index_find_between", ("o_custkey", "between", 10, 20), "o_custkey between 10 and 20")):
    query(f"select o_orderkey::varchar as id from orders where {_sql}", _name)(lambda spark, sf_dir, args=_args: orders(spark, sf_dir).find(*args))


@query("select o_orderkey::varchar as id from orders where o_orderstatus = 'O' and o_custkey between 100 and 200")
def composite_find(spark, sf_dir):
    return orders(spark, sf_dir).find_composite([("o_orderstatus", "O", "O"), ("o_custkey", 100, 200), ("o_totalprice", ..., ...)])


@query("select o_orderkey::varchar as id from orders where o_custkey = 5 or o_totalprice > 400000 or o_orderstatus = 'P'")
def or_union_ids(spark, sf_dir):
    of = orders(spark, sf_dir)
    return union_ids(of.find("o_custkey", "eq", 5), of.find("o_totalprice", "gt", 4e5), of.find("o_orderstatus", "eq", "P"))


@query(f"select {', '.join(ORDER)} from orders")
def collection_scan(spark, sf_dir):
    return orders(spark, sf_dir).scan()


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 7")
def entity_get(spark, sf_dir):
    return orders(spark, sf_dir).get("7").select("o_orderkey", "o_totalprice")


@query("select o_orderkey::varchar as id, o_custkey, o_totalprice, o_orderstatus from orders")
def entity_assemble(spark, sf_dir):
    wide = orders(spark, sf_dir).rows
    kinds = {f.name: f.dataType for f in wide.schema.fields}
    triples = wide.select(F.col("o_orderkey").cast("string").alias("id"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), values.of_column(F.col(n), kinds[n]).alias("value")) for n in ("o_custkey", "o_totalprice", "o_orderstatus")))).alias("x")).select("id", "x.*")
    f = F.col("fields")
    return assembled(triples).select("id", f["o_custkey"]["i"].alias("o_custkey"), f["o_totalprice"]["f"].alias("o_totalprice"), f["o_orderstatus"]["s"].alias("o_orderstatus"))


# The change log: events by user; an error deletes what the user had.
def changes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


LIVE = "select user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events{}) where n = 1"
KEPT = ("event_type", "value")


@query(LIVE.format("") + " and event_type <> 'error'")
def lww_merge(spark, sf_dir):
    return log.merged(changes(spark, sf_dir), "user_id", "event_id", "deleted", *KEPT)


@query(LIVE.format("") + " and event_type = 'error'")
def lww_tombstone(spark, sf_dir):
    return log.newest(changes(spark, sf_dir), "user_id", "event_id", "deleted", *KEPT).where("deleted").drop("deleted")


@query(LIVE.format(" where user_id = 3") + " and event_type <> 'error'")
def kv_get(spark, sf_dir):
    return log.point(changes(spark, sf_dir), "user_id", 3, "event_id", "deleted", *KEPT)


@query(LIVE.format(" where user_id >= 5 and user_id < 60") + " and event_type <> 'error'")
def kv_range_scan(spark, sf_dir):
    return log.scanned(changes(spark, sf_dir), "user_id", "event_id", "deleted", *KEPT, start=5, end=60)


@query(LIVE.format(" where user_id >= 5"))
def kv_scan_with_tombstones(spark, sf_dir):
    return log.scanned(changes(spark, sf_dir), "user_id", "event_id", "deleted", *KEPT, start=5, tombstones=True).drop("deleted")


@query(LIVE.format(" where event_id // 10 in (select event_id // 10 from events where event_type = 'signup')") + " and event_type <> 'error'")
def wal_replay_committed(spark, sf_dir):
    tx = F.floor(F.col("event_id") / 10)
    return log.merged(log.replayed(changes(spark, sf_dir), tx, F.col("event_type") == "signup"), "user_id", "event_id", "deleted", *KEPT)


def pending(spark, sf_dir) -> DataFrame:
    """A transaction's writes: every seventh order is cheaper, every eleventh is deleted."""
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).rows.where((k % 7 == 0) | (k % 11 == 0)).select("o_orderkey", (F.col("o_totalprice") - 1).alias("o_totalprice"), "o_orderstatus", (k % 11 == 0).alias("deleted"))


@query(f"select {ROW} from (select o_orderkey, o_orderstatus, case when o_orderkey % 7 = 0 then o_totalprice - 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 11 <> 0) where o_totalprice > 200000")
def tx_overlay_query(spark, sf_dir):
    seen = mutations.overlaid(orders(spark, sf_dir).rows.select(*ROW.split(", ")), pending(spark, sf_dir), "o_orderkey")
    return Collection(seen, F.col("o_orderkey").cast("string")).query().filter(gt("o_totalprice", 2e5)).rows()


@query(f"select {ROW} from orders where o_orderkey % 11 <> 0")
def tx_delete_overlay(spark, sf_dir):
    return mutations.overlaid(orders(spark, sf_dir).rows.select(*ROW.split(", ")), pending(spark, sf_dir).where("deleted"), "o_orderkey")


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null else o_custkey end as o_custkey, o_orderstatus from orders")
def put_replace(spark, sf_dir):
    rows = orders(spark, sf_dir).rows.select("o_orderkey", "o_custkey", "o_orderstatus")
    return mutations.put(rows, rows.where("o_orderkey % 7 = 0").drop("o_custkey"), "o_orderkey")


def cas(spark, sf_dir):
    base = orders(spark, sf_dir).rows.select("o_orderkey", "o_custkey", "o_orderstatus")
    wanted = base.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(100000000)).alias("o_orderkey"))
    return mutations.compare_and_set(base, wanted, "o_orderkey", F.col("o_orderstatus") == "O", {"o_custkey": mutations.wrapped(F.col("o_custkey"), F.lit(9223372036854775807)), "o_orderstatus": F.lit(None).cast("string")})


@query("select o_orderkey, (case when not hit then o_custkey when o_custkey = 0 then 9223372036854775807 else -9223372036854775808::hugeint + o_custkey - 1 end)::bigint as o_custkey, case when hit then null else o_orderstatus end as o_orderstatus from (select *, o_orderkey % 10 = 0 and o_orderstatus = 'O' as hit from orders)")
def cas_patch_increment_remove(spark, sf_dir):
    return cas(spark, sf_dir)[0]


@query("select o_orderkey + case when o_orderkey % 2 = 0 then 0 else 100000000 end as o_orderkey, 'ExpectedFieldMismatch' as reason from orders where o_orderkey % 5 = 0 and (o_orderkey % 2 = 1 or o_orderstatus <> 'O')")
def cas_conflicts(spark, sf_dir):
    return cas(spark, sf_dir)[1]


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 123456.5 and o_orderstatus in ('O', 'P') order by o_totalprice, o_orderkey limit 25 offset 5")
def sql_with_parameters(spark, sf_dir):
    """Text queries are Spark SQL with named parameters."""
    return spark.sql("select o_orderkey, o_totalprice from {t} where o_totalprice >= :least and o_orderstatus in (:a, :b) order by o_totalprice, o_orderkey limit 25 offset 5", args={"least": 123456.5, "a": "O", "b": "P"}, t=read(spark, sf_dir, "orders"))


# The largest table, by time.
LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
LINE_ID = "l_orderkey::varchar || '-' || l_linenumber::varchar"
FROM, TO = datetime.date(1995, 3, 1), datetime.date(1995, 9, 15)
DATES = f"l_shipdate >= timestamp '{FROM}' and l_shipdate <= timestamp '{TO}'"


def lines(spark: SparkSession, sf_dir: str, **options) -> Collection:
    return Collection(read(spark, sf_dir, "lineitem").select(*LINE), F.concat_ws("-", "l_orderkey", "l_linenumber"), **options)


@query(f"select l_orderkey, l_linenumber, l_extendedprice from lineitem where {DATES} and l_returnflag = 'R' and l_quantity >= 30 order by l_extendedprice desc, {LINE_ID} limit 50")
def line_dear_returns(spark, sf_dir):
    p = between("l_shipdate", FROM, TO) & eq("l_returnflag", "R") & ge("l_quantity", 30.0)
    return lines(spark, sf_dir).query().filter(p).sort("l_extendedprice", True).limit(50).rows().select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"select l_orderkey, l_linenumber, l_shipdate from lineitem order by l_shipdate desc nulls last, {LINE_ID} limit 40")
def line_newest(spark, sf_dir):
    return lines(spark, sf_dir).query().sort("l_shipdate", True).limit(40).rows().select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"select {LINE_ID} as id from lineitem where l_returnflag = 'A' and {DATES}")
def line_composite_find(spark, sf_dir):
    return lines(spark, sf_dir).find_composite([("l_returnflag", "A", "A"), ("l_shipdate", FROM, TO)])


@query(f"select round(sum(l_extendedprice), 2) as result from lineitem where not ({DATES})")
def line_sum_outside_dates(spark, sf_dir):
    return lines(spark, sf_dir).query().filter(~between("l_shipdate", FROM, TO)).aggregate("sum", "l_extendedprice").result().select(F.round("result", 2).alias("result"))


@query("select epoch_us(max(l_shipdate)) as result from lineitem where l_quantity < 10")
def line_latest_as_int(spark, sf_dir):
    return lines(spark, sf_dir).query().filter(lt("l_quantity", 10.0)).aggregate("max", "l_shipdate").result()


@query(f"select {LINE_ID} as id from lineitem where l_shipdate > timestamp '{TO}' and l_discount >= 0.05")
def line_dynamic_dates(spark, sf_dir):
    of = lines(spark, sf_dir)
    rows = dynamic_rows(of.rows, of.id, ["l_shipdate", "l_discount", "l_returnflag"])
    return Collection(rows, F.col("id"), fields="fields").query().filter(gt("l_shipdate", TO) & ge("l_discount", 0.05)).rows().select("id")


@query("select l_returnflag, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, max(l_shipdate) as latest from lineitem group by l_returnflag")
def line_revenue_by_flag(spark, sf_dir):
    return lines(spark, sf_dir).rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.max("l_shipdate").alias("latest"))


def zeros(spark: SparkSession, sf_dir: str) -> Collection:
    """Lines with a discount of -0.0, 0.0 or what it was."""
    of, k = lines(spark, sf_dir), F.col("l_linenumber") % 3
    return Collection(of.rows.withColumn("l_discount", F.when(k == 0, F.lit(-0.0)).when(k == 1, F.lit(0.0)).otherwise(F.col("l_discount"))), of.id)


for _name, _p, _sql in (("zero_lt", lt("l_discount", 0.0), "l_linenumber % 3 = 0"), ("zero_eq", eq("l_discount", 0.0), "l_linenumber % 3 = 1 or l_linenumber % 3 = 2 and l_discount = 0"), ("zero_not_le_negative", ~le("l_discount", -0.0), "l_linenumber % 3 <> 0")):
    query(f"select {LINE_ID} as id from lineitem where {_sql}", _name)(lambda spark, sf_dir, p=_p: zeros(spark, sf_dir).query().filter(p).project("l_discount").rows().select("id"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey::varchar offset 100")
def offset_without_limit(spark, sf_dir):
    return orders(spark, sf_dir).query().sort("o_totalprice").offset(100).rows().select("o_orderkey", "o_totalprice")


@query("select o_orderkey, case when o_orderkey % 7 = 0 then 3.0 else o_totalprice end as o_totalprice, o_orderstatus from orders where o_orderkey % 7 <> 0 or o_orderkey % 2 = 0")
def tx_several_writes(spark, sf_dir):
    """A transaction that writes each seventh order three times, the odd ones' last write being a delete."""
    base = orders(spark, sf_dir).rows.select(*ROW.split(", "))
    writes = base.where("o_orderkey % 7 = 0").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    writes = writes.withColumn("o_totalprice", F.col("step").cast("double")).withColumn("deleted", (F.col("step") == 3) & (F.col("o_orderkey") % 2 == 1))
    return mutations.overlaid(base, writes, "o_orderkey", order="step")


@query("select o_orderkey, case when o_orderkey % 5 = 0 then o_orderkey % 5 + 2 else o_custkey end as o_custkey from orders")
def cas_last_write_counts(spark, sf_dir):
    base = orders(spark, sf_dir).rows.select("o_orderkey", "o_custkey")
    wanted = base.where("o_orderkey % 5 = 0").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("step")).withColumn("to", F.col("step").cast("long"))
    return mutations.compare_and_set(base, wanted, "o_orderkey", F.lit(True), {"o_custkey": F.col("to")}, order="step")[0]
