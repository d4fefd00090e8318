"""Sharding: extendible hashing, by DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash of doc_id. It begins as one bucket; only a bucket over
the byte limit is split on another bit, until every bucket fits. The split is computed from byte sums by hash prefix,
twelve bits a round; a round looks only at rows whose prefix is still too large.

Rows that share all 60 bits (one id repeated, or one document over the limit) can't be split by bits: they fill numbered
parts in the order of their texts' hashes, found by running sums over 4096 ranges of that hash and inside each, so that
one repeated id is no single task's work. A document of over half the limit is a part of its own (odd numbers); the others
are cut at every half of the limit in their running sum (even numbers), so that no part of several documents is over
the limit. Rows equal in id, size and text count as one with a number until they are numbered.

Null texts have no bytes; a null doc_id is hashed as the empty string. Further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, save, table

LIMIT = 1 << 20
WIDTH = 60
STEP = 12


def hashed(c) -> "F.Column":
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(spark: SparkSession, rows: DataFrame, limit: int) -> DataFrame:
    """Parts of the rows that share a hash. A group of equal rows stands at `start` of the running sum of its hash."""
    rows = rows.withColumn("big", F.col("bytes") * 2 > limit).groupBy("h", "doc_id", "bytes", "order", "big").agg(F.count(F.lit(1)).alias("n"))
    # big documents are counted, the others summed
    rows = save(spark, rows.withColumn("size", F.when(F.col("big"), F.lit(1)).otherwise(F.col("bytes"))).withColumn("span", F.shiftrightunsigned("order", 52)), "shard-equal-rows")
    spans = rows.groupBy("h", "big", "span").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    spans = spans.withColumn("base", F.sum("total").over(Window.partitionBy("h", "big").orderBy("span")) - F.col("total")).drop("total")
    inside = Window.partitionBy("h", "big", "span").orderBy("order", "bytes", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = looked_up(spark, rows, save(spark, spans, "shard-spans"), ["h", "big", "span"])
    rows = rows.withColumn("start", F.col("base") + F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    # a large number of equal rows is written out by many tasks
    some = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1 << 16).cast("long")))).repartition("h", "order", "first")
    each = some.withColumn("at", F.explode(F.sequence("first", F.least(F.col("first") + (1 << 16), "n") - 1)))
    start = F.col("start") + F.col("size") * F.col("at")
    part = F.when(F.col("big"), start * 2 + 1).otherwise(F.floor(start / max(1, limit // 2)) * 2)
    each = save(spark, each.select("doc_id", "bytes", F.lit(WIDTH).alias("depth"), F.col("h").alias("prefix"), part.cast("long").alias("part")), "shard-parts")
    sums = save(spark, each.groupBy("prefix", "part").agg(F.sum("bytes").alias("shard_bytes")), "shard-part-bytes")
    return looked_up(spark, each, sums, ["prefix", "part"]).select("doc_id", "bytes", "depth", "prefix", "part", "shard_bytes")


def directory(placed: DataFrame) -> DataFrame:
    """One row for each shard of shards(): its leading hash bits as text, part, bytes and documents. The entries of a
    directory of the greatest depth that begin with these bits point to it."""
    shard = placed.groupBy("depth", "prefix", "part").agg(F.max("shard_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("documents"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return shard.select(bits.alias("bits"), "part", "shard_bytes", "documents")


def shards(spark: SparkSession, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, depth, prefix, part, shard_bytes): depth bits of the hash, as a number, name the shard."""
    rows = save(spark, docs.select(F.col("doc_id").cast("long"), hashed(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("text").alias("order")), "shard-rows")
    active, out = rows, []
    for bits in range(STEP, WIDTH + 1, STEP):
        cell = F.shiftright("h", WIDTH - bits).alias("cell")
        cells = active.groupBy(cell).agg(F.sum("bytes").alias("bytes"))
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0 if bits == STEP else bits - STEP + 1), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        best = levels.join(fits, ["depth", "prefix"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "prefix", "shard_bytes"))).alias("s"))
        best = save(spark, best, "shard-directory")
        placed = looked_up(spark, active.withColumn("cell", cell), best, ["cell"])
        out.append(placed.where("s is not null").select("doc_id", "bytes", "s.depth", "s.prefix", F.lit(0).cast("long").alias("part"), "s.shard_bytes"))
        left = best.where("s is null").select("cell")
        if not left.limit(1).count():
            break
        active = placed.where("s is null").drop("cell", "s")
    else:
        out.append(numbered(spark, active, limit))
    return reduce(DataFrame.unionByName, out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, table(spark, sf_dir, "documents"))


#: The same by brute force: byte sums for every depth.
SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
l as (select *, unnest(range(0, 61)) as depth from d),
s as (select depth, h >> ({WIDTH} - depth) as prefix, sum(bytes)::bigint as shard_bytes from l group by all having sum(bytes) <= {LIMIT})
select doc_id, bytes, depth::int as depth, prefix::bigint as prefix, 0::bigint as part, shard_bytes from (
  select d.*, s.*, row_number() over (partition by d.doc_id order by s.depth) as k from d join s on (d.h >> ({WIDTH} - s.depth)) = s.prefix) where k = 1
"""
