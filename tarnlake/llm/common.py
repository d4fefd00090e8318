"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..sources.scratch import new_path, small  # noqa: F401  # operators take both from here

#: How tables of large rows are written: Parquet looks at a page's size after each row, not after 100 rows first.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1"}
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

#: What a Python worker keeps from task to task, of one operator only: Spark gives one worker the tasks of all.
_held: dict[str, object] = {}

#: Paths and schemas of saved tables, in order.
_saved: list[tuple] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing. options: of the writer."""
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    _saved.append((path, df.schema))
    return spark.read.schema(df.schema).parquet(path)


def held(key: str, make: Callable[[], object]) -> object:
    """The worker's own object of that key, made once; what it kept for another key goes."""
    if key not in _held:
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """What other operators' tasks left in this worker goes back to the system: kept objects, Arrow's pool, the C heap's free pages."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def few_rows_read(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside decodes so many rows of Parquet at a time: Spark's 4,096 large rows are a whole file."""
    before = spark.conf.get(READ_ROWS)
    spark.conf.set(READ_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(READ_ROWS, before)


def saved_so_far() -> int:
    return len(_saved)


def empty_saved(spark: SparkSession, since: int = 0) -> None:
    """Empty the tables saved since then, once nothing reads them any more."""
    while len(_saved) > since:
        path, schema = _saved.pop()
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def fits(df: DataFrame, rows: int = 50_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def looked_up(spark: SparkSession, rows: DataFrame, named: DataFrame, on: list[str], how: str = "inner", hot: int = 10_000, few: int = 50_000) -> DataFrame:
    """rows joined with `named`, which has one narrow row for each key.

    A small `named` is broadcast. Else the keys that more than one row in `hot` has, which are fewer than `hot`, are looked
    up by broadcast and the others by a shuffle, so that no key's rows meet in one task. Null keys match nothing.
    """
    if fits(named, few):
        return rows.join(F.broadcast(named), on, how)
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    keyed = rows.where(known)
    heavy = keyed.groupBy(*on).count().where(F.col("count") > F.greatest(F.lit(1000), F.lit(rows.count() // hot))).select(*on)
    heavy = F.broadcast(save(spark, heavy, "heavy-keys"))
    out = keyed.join(heavy, on, "left_anti").join(named, on, how)
    out = out.unionByName(keyed.join(heavy, on, "left_semi").join(F.broadcast(named.join(heavy, on, "left_semi")), on, how))
    if how in ("left", "left_anti"):
        out = out.unionByName(rows.where(~known), allowMissingColumns=True)
    return out


def by_group(df: DataFrame, gid: str, *order: str) -> DataFrame:
    """Rows of a group together and in order, for groups(). Each gid must be small: hot keys are split before."""
    return df.repartition(gid).sortWithinPartitions(gid, *order)


def groups(batches: Iterator[pa.RecordBatch], gid: str) -> Iterator[pa.Table]:
    """The groups of by_group(), one after the other, each held alone."""
    part: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = batch.column(gid).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if part and ids[a] != last:
                yield pa.Table.from_batches(part)
                part = []
            last = ids[a]
            part.append(batch.slice(a, b - a))
    if part:
        yield pa.Table.from_batches(part)


def many_groups(batches: Iterator[pa.RecordBatch], gid: str, rows: int) -> Iterator[pa.Table]:
    """Whole groups joined to tables of about so many rows, to spare the cost of each call."""
    part: list[pa.Table] = []
    n = 0
    for t in groups(batches, gid):
        part.append(t)
        n += len(t)
        if n >= rows:
            yield pa.concat_tables(part)
            part, n = [], 0
    if part:
        yield pa.concat_tables(part)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text, so that memory does not follow the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(sizes):
        b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + size)) + 1
        yield batch.slice(a, b - a)
        a = b


def letter_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-cased runs of letters of each text: an index into the distinct words for each, those words, and where each text begins."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    parts = pc.ascii_split_whitespace(low)
    flat = parts.flatten()
    some = pc.not_equal(flat, "")  # the split leaves an empty word before a blank at the beginning, and after one at the end
    coded = flat.filter(some).dictionary_encode()
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    bounds = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])]
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], rows at axis 0; empty ones are 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def scored(rows: DataFrame, score, kinds: dict[str, str], keep_text: bool, constant: dict | None = None) -> DataFrame:
    """(row, [text,] *kinds): `row` holds the other columns of rows, so no name can clash. score: a function from an Arrow array of texts to the arrays of kinds."""
    inner = rows.select(F.struct(F.lit(1).alias("_"), *(F.col(f"`{c}`") for c in rows.columns if c != "text")).alias("row"), "text")
    kept = ["row", "text"] if keep_text else ["row"]
    if score is None:
        return inner.select(*kept, *(c.alias(k) for k, c in constant.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *score(batch.column("text"))], names=[*kept, *kinds])

    schema = inner.select(*kept).schema
    for k, kind in kinds.items():
        schema = schema.add(k, kind)
    return inner.mapInArrow(run, schema)


def row_columns(rows: DataFrame) -> list:
    """The columns of rows, from the result of scored() with its text."""
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in rows.columns]


def deal(spark: SparkSession, keyed: DataFrame, id_column: str, block: int) -> DataFrame:
    """Rows of keyed (with a `bucket`) by group: gid, side. A bucket of at most `block` rows is one group, of side 0.

    A larger one is cut at random into parts of about `block` rows, and each pair of parts is a group, of sides 0 and
    1; so no task holds a hot bucket, and each pair of its rows meets in one group at least.
    """
    sized = save(spark, keyed.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).alias("parts")), "hot-buckets")
    parts = F.coalesce("parts", F.lit(1))
    dealt = looked_up(spark, keyed, sized, ["bucket"], "left").withColumn("part", F.pmod(F.xxhash64(id_column, F.lit(7)), parts))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct(F.least(j, "part").alias("a"), F.greatest(j, "part").alias("b")))
    return dealt.withColumn("pair", F.explode(pairs)).withColumn("gid", F.xxhash64("bucket", "pair.a", "pair.b")).withColumn("side", (F.col("part") > F.col("pair.a")).cast("int")).drop("bucket", "parts", "part", "pair")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new
