"""Queries over what was written before: streams, compaction, backups, and updates under a condition. queries.py adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import gt
from ..functions import values
from ..operators import log, mutations, patches
from ..sources.scratch import new_path
from ..streaming import upsert
from .collection import Collection, dynamic_rows

KEYS = ("user_id", "event_id", "deleted")
KEPT = ("event_type", "value")
LIVE = "select user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1 and event_type <> 'error'"


def changes(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "user_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log read as a stream and folded batch by batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = changes(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*"))
    out = new_path(spark, "stream")
    upsert.upsert(stream, f"{out}/state", f"{out}/checkpoint", *KEYS, *KEPT).awaitTermination()
    return upsert.state(spark, f"{out}/state", *KEYS, *KEPT)


def compact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log compacted to disjoint key ranges, and read again."""
    out = new_path(spark, "compacted")
    log.compact(changes(spark.read.parquet(f"{sf_dir}/events.parquet")), *KEYS, *KEPT, path=out)
    return spark.read.parquet(out)


def folder_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection saved, replaced, backed up and read from the backup: Parquet folders, the later one in key order."""
    rows, kept, backup = orders(spark, sf_dir), new_path(spark, "collection"), new_path(spark, "backup")
    rows.where("o_orderkey % 2 = 0").write.parquet(kept)
    rows.repartitionByRange("o_custkey").sortWithinPartitions("o_custkey").write.mode("overwrite").parquet(kept)
    spark.read.parquet(kept).write.parquet(backup)
    return spark.read.parquet(backup)


def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of found ids; ids without a row are dropped."""
    of = Collection(orders(spark, sf_dir), F.col("o_orderkey").cast("string"), key="o_orderkey")
    return of.fetch(of.find("o_custkey", "between", 10, 20).unionByName(spark.createDataFrame([("none",), ("007",)], "id string")))


def wanted(rows: DataFrame) -> DataFrame:
    """Keys to update: every fifth order, of which the odd ones are not there."""
    return rows.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(100000000)).alias("o_orderkey"))


def cas_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return mutations.compare_and_set(rows, wanted(rows), "o_orderkey", F.lit(True), {"o_orderstatus": F.lit("X")}, absent_ok=True)[0]


def absent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir)
    return mutations.compare_and_set(rows, wanted(rows), "o_orderkey", F.lit(False), {"o_orderstatus": F.lit("X")}, absent_ok=True, mismatch="ExpectedAbsentButExists")


def cas_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absent(spark, sf_dir)[0]


def cas_absent_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return absent(spark, sf_dir)[1]


def cas_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicts of an update that expects whole rows: those of every third key are out of date."""
    rows = orders(spark, sf_dir)
    expected = rows.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("custkey"), F.col("o_orderstatus").alias("orderstatus"))
    same = F.col("o_custkey").eqNullSafe(F.col("custkey")) & F.col("o_orderstatus").eqNullSafe(F.col("orderstatus"))
    return mutations.compare_and_set(rows, expected, "o_orderkey", same, {"o_orderstatus": F.lit("X")}, mismatch="ExpectedValueMismatch")[1]


def tx_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that sees the transaction's own writes: every seventh order goes to customer 1, every eleventh is deleted."""
    rows = orders(spark, sf_dir)
    pending = rows.where("o_orderkey % 7 = 0 or o_orderkey % 11 = 0").withColumn("o_custkey", F.lit(1).cast("long")).withColumn("deleted", F.col("o_orderkey") % 11 == 0)
    seen = mutations.overlaid(rows, pending, "o_orderkey")
    return Collection(seen, F.col("o_orderkey").cast("string")).query().filter(gt("o_custkey", 0)).aggregate("sum", "o_custkey").result()


def group_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping, as an extension."""
    return orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.max("o_custkey").alias("highest"))


def written(rows: DataFrame, tx: int, step: int, kind: str = "put") -> DataFrame:
    """Rows of a log: writes of a transaction, its deletes, or the row that commits it."""
    return rows.select(F.struct(F.lit(tx).alias("tx"), F.lit(step).alias("step")).alias("at"), F.lit(kind).alias("kind"), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string"))))


def live(rows: DataFrame) -> DataFrame:
    """What committed transactions left."""
    counted = log.replayed(rows, F.col("at.tx"), F.col("kind") == "commit").where("kind <> 'commit'")
    return log.merged(counted.withColumn("deleted", F.col("kind") == "delete"), "o_orderkey", "at", "deleted", "o_custkey", "o_orderstatus")


def tx_commit_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with three transactions: all orders; changes to every seventh and deletes of every eleventh; deletes of all, without a commit."""
    rows, end = orders(spark, sf_dir), spark.range(1).select()
    parts = [written(rows, 1, 1), written(end, 1, 2, "commit"), written(rows.where("o_orderkey % 7 = 0").drop("o_custkey"), 2, 1), written(rows.where("o_orderkey % 11 = 0"), 2, 2, "delete"), written(end, 2, 3, "commit"), written(rows, 3, 1, "delete")]
    path = new_path(spark, "log")
    for part in parts:
        part.write.mode("append").parquet(path)
    return live(spark.read.parquet(path))


def log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a transaction that was never committed, compacted to its live rows in key order."""
    rows, end = orders(spark, sf_dir), spark.range(1).select()
    whole = written(rows, 1, 1).unionByName(written(rows.where("o_orderstatus = 'P'"), 1, 2, "delete")).unionByName(written(end, 1, 3, "commit")).unionByName(written(rows, 2, 1))
    path = new_path(spark, "log")
    live(whole).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


def documents_of(rows: DataFrame) -> DataFrame:
    """Orders as dynamic rows; finished ones have no status."""
    rows = rows.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return dynamic_rows(rows, F.col("o_orderkey").cast("string"), ["o_custkey", "o_orderstatus"])


def patched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every third order (and one key in it that is not there): if its status is open, add to the customer, remove the status, set a note."""
    base = documents_of(orders(spark, sf_dir))
    ids = base.where("cast(id as long) % 3 = 0").select("id").unionByName(spark.createDataFrame([("none",)], "id string"))
    steps = [patches.add_to_field("o_custkey", 2**63 - 1), patches.drop_field("o_orderstatus"), patches.put_field("note", "late"), patches.put_field("note", "seen")]
    return patches.update(base, ids, "id", patches.same(F.col("fields")["o_orderstatus"], values.literal("O")), steps)


def patch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fields")
    return patched(spark, sf_dir)[0].select("id", f["o_custkey"]["i"].alias("o_custkey"), f["o_orderstatus"]["s"].alias("o_orderstatus"), f["note"]["s"].alias("note"), F.size("fields").alias("n"))


def patch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patched(spark, sf_dir)[1]


def patch_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An increment of the status suits no order."""
    base = documents_of(orders(spark, sf_dir))
    return patches.update(base, base.select("id"), "id", F.lit(True), [patches.put_field("note", 1), patches.add_to_field("o_orderstatus", 1)])[1]


def cas_whole_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that expect whole dynamic rows, those of every fourth key without the status; what is refused."""
    base = documents_of(orders(spark, sf_dir))
    stale = F.col("id").cast("long") % 4 == 0
    expected = base.select("id", F.when(stale, F.map_filter("fields", lambda k, _: k != "o_orderstatus")).otherwise(F.col("fields")).alias("seen"))
    return patches.update(base, expected, "id", patches.same_fields(F.col("fields"), F.col("seen")), [patches.put_field("note", "x")], mismatch="ExpectedValueMismatch")[1]


def project_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the order asked for, one of them twice, absent ones left out."""
    of = Collection(documents_of(orders(spark, sf_dir)), F.col("id"), fields="fields")
    out = of.query().project("o_orderstatus", "none", "o_custkey", "o_orderstatus").entries()
    return out.select("id", F.array_join(F.transform("entries", lambda e: F.concat(e["field"], F.lit("="), F.coalesce(e["value"]["s"], e["value"]["i"].cast("string")))), " ").alias("line"))


def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection rewritten in the order of two fields, by whose ranges a scan then skips files, asked for a range of them."""
    path = new_path(spark, "collection")
    orders(spark, sf_dir).repartitionByRange("o_orderstatus", "o_custkey").sortWithinPartitions("o_orderstatus", "o_custkey").write.parquet(path)
    of = Collection(spark.read.parquet(path), F.col("o_orderkey").cast("string"), key="o_orderkey")
    return of.find_composite([("o_orderstatus", "P", "P"), ("o_custkey", 50, 900)])


KEY = "o_orderkey + case when o_orderkey % 2 = 0 then 0 else 100000000 end"
ADDED = f"select {KEY} as o_orderkey, null::bigint as o_custkey, 'X' as o_orderstatus from orders where o_orderkey % 5 = 0 and o_orderkey % 2 = 1"
QUERIES = {f.__name__: f for f in (stream_upsert, compact_full, folder_restore, fetch, cas_any, cas_absent, cas_absent_conflicts, cas_entity, tx_aggregate, group_by_status, tx_commit_abort, log_compact, patch_steps, patch_conflicts, patch_invalid, cas_whole_dynamic, project_entries, index_rebuilt)}
ORACLE_SQL = {
    "stream_upsert": LIVE,
    "compact_full": LIVE,
    "folder_restore": "select o_orderkey, o_custkey, o_orderstatus from orders",
    "fetch": "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey between 10 and 20",
    "cas_any": f"select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders union all {ADDED}",
    "cas_absent": f"select o_orderkey, o_custkey, o_orderstatus from orders union all {ADDED}",
    "cas_absent_conflicts": "select o_orderkey, 'ExpectedAbsentButExists' as reason from orders where o_orderkey % 10 = 0",
    "cas_entity": "select o_orderkey, 'ExpectedValueMismatch' as reason from orders where o_orderkey % 15 = 0",
    "tx_aggregate": "select sum(case when o_orderkey % 7 = 0 then 1 else o_custkey end)::bigint as result from orders where o_orderkey % 11 <> 0 and (o_orderkey % 7 = 0 or o_custkey > 0)",
    "tx_commit_abort": "select o_orderkey, case when o_orderkey % 7 <> 0 then o_custkey end as o_custkey, o_orderstatus from orders where o_orderkey % 11 <> 0",
    "log_compact": "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'P'",
    "patch_steps": "select o_orderkey::varchar as id, (case when not hit then o_custkey when o_custkey = 0 then 9223372036854775807 else -9223372036854775808::hugeint + o_custkey - 1 end)::bigint as o_custkey, case when not hit then nullif(o_orderstatus, 'F') end as o_orderstatus, case when hit then 'seen' end as note, (case when hit or o_orderstatus <> 'F' then 2 else 1 end)::int as n from (select *, o_orderkey % 3 = 0 and o_orderstatus = 'O' as hit from orders)",
    "patch_conflicts": "select o_orderkey::varchar as id, 'ExpectedFieldMismatch' as reason from orders where o_orderkey % 3 = 0 and o_orderstatus <> 'O' union all select 'none', 'ExpectedFieldMismatch'",
    "patch_invalid": "select o_orderkey::varchar as id, 'InvalidArgument' as reason from orders",
    "cas_whole_dynamic": "select o_orderkey::varchar as id, 'ExpectedValueMismatch' as reason from orders where o_orderkey % 4 = 0 and o_orderstatus <> 'F'",
    "project_entries": "select o_orderkey::varchar as id, case when o_orderstatus = 'F' then 'o_custkey=' || o_custkey else 'o_orderstatus=' || o_orderstatus || ' o_custkey=' || o_custkey || ' o_orderstatus=' || o_orderstatus end as line from orders",
    "index_rebuilt": "select o_orderkey::varchar as id from orders where o_orderstatus = 'P' and o_custkey between 50 and 900",
    "group_by_status": "select o_orderstatus, count(*) as orders, max(o_custkey) as highest from orders group by o_orderstatus",
}
