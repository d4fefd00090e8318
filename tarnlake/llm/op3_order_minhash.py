"""Document fingerprints: Order MinHash, by DataFrame functions only.

The k-mers are runs of three words of the whole text (at its end shorter ones), each numbered by its occurrence: the
second of the same k-mer is another element than the first. A hash puts the elements on a ring of numbers. An order is
the ring begun at one of 128 points, so all orders come from one hash (circulant permutations); the minimal element of an
order is the first from its point on. Each of 64 sketches has two orders, takes the minimal element of each (of the same
one twice, that and the next), puts them in the order in which they stand in the text, and hashes the pair. So every
sketch of a text of two elements or more carries order, however short the text, and two fingerprints agree in a sketch
only if the same k-mers are there in the same order. The fingerprint is a string of the sketches, 8 hex digits each; the
likeness of two is the share of equal ones, of two empty ones 1.

Null and blank texts have the empty fingerprint. Documents are ordered by falling doc_id (nulls last); rows that share an
id, or have none, follow each other in no particular order; the next of the last is the first, of a single document
itself. Further columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

BITS = 30
HERE = (1 << BITS) - 1
#: Sketches, the points at which their orders begin (arcs of the ring), and the second order of each sketch; its first is that of its own number.
SKETCHES, ARC_BITS = 64, 7
POINTS = 1 << ARC_BITS
PARTNERS = [SKETCHES + (37 * n + 11) % SKETCHES for n in range(SKETCHES)]
SPACE = " \t\n\x0b\x0c\r"


def _hash(x: Column) -> Column:
    return F.shiftright(x, BITS)


def _element(h: Column, at: Column) -> Column:
    return F.shiftleft(h, BITS).bitwiseOR(at)


def sketched(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array of (sketch number, hash) in one long each. Each step is a column of its own, so that nothing is computed twice."""
    bare = F.trim(F.col(text), F.lit(SPACE))
    df = df.withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_h", F.sort_array(F.transform("_w", lambda x, i: _element(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)), i.cast("long"))))).drop("_w")
    again = lambda x, i: F.coalesce(_hash(F.get("_h", i - 1)) == _hash(x), F.lit(False))
    df = df.withColumn("_a", F.filter("_h", again))
    # occurrence numbers of what is not the first of its kind: its place in its run of equal hashes
    starts = F.filter(F.sequence(F.lit(0), F.size("_a") - 1), lambda i: F.coalesce(_hash(F.get("_a", i - 1)) != _hash(F.get("_a", i)), F.lit(True)))
    df = df.withColumn("_s", F.when(F.size("_a") > 0, starts))
    runs = F.transform("_s", lambda a, j: F.transform(F.slice("_a", a + 1, F.coalesce(F.get("_s", j + 1), F.size("_a")) - a), lambda x, n: _element(F.xxhash64(_hash(x), n), x.bitwiseAND(HERE))))
    df = df.withColumn("_k", F.when(F.size("_a") == 0, F.col("_h")).otherwise(F.sort_array(F.concat(F.filter("_h", lambda x, i: ~again(x, i)), F.flatten(runs))))).drop("_h", "_a", "_s")
    # first element of each occupied arc of the ring, with the arc's number
    arc = lambda x: F.shiftrightunsigned(x, 64 - ARC_BITS).cast("int").bitwiseXOR(POINTS // 2)  # noqa: E731  # signed hashes begin with the upper half
    first = F.filter(F.sequence(F.lit(0), F.size("_k") - 1), lambda i: F.coalesce(arc(F.get("_k", i - 1)) != arc(F.get("_k", i)), F.lit(True)))
    df = df.withColumn("_f", F.when(F.size("_k") > 0, first).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_g", F.transform("_f", lambda i: arc(F.get("_k", i))))
    # it serves the empty arcs before it too; those after the last go round to the first
    filled = F.flatten(F.transform("_f", lambda i, j: F.array_repeat(i, F.get("_g", j) - F.coalesce(F.get("_g", j - 1), F.lit(-1)))))
    df = df.withColumn("_m", F.concat(filled, F.array_repeat(F.lit(0), POINTS - 1 - F.coalesce(F.get("_g", F.size("_g") - 1), F.lit(POINTS - 1))))).drop("_f", "_g")

    def pair(n: Column, p: Column, q: Column) -> Column:
        q = F.when(p != q, q).otherwise((p + 1) % F.size("_k"))
        a, b = F.get("_k", p), F.get("_k", q)
        x, y = F.when(a.bitwiseAND(HERE) <= b.bitwiseAND(HERE), a).otherwise(b), F.when(a.bitwiseAND(HERE) <= b.bitwiseAND(HERE), b).otherwise(a)
        return F.shiftleft(n.cast("long") + 1, 32).bitwiseOR(F.xxhash64(_hash(x), _hash(y)).bitwiseAND(0xFFFFFFFF))

    at = F.array(*map(F.lit, PARTNERS))
    pairs = F.transform(F.slice("_m", 1, SKETCHES), lambda p, n: pair(n, p, F.get("_m", F.get(at, n))))
    return df.withColumn(out, pairs).drop("_k", "_m")


def written(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    of = F.greatest(F.size(a), F.size(b))
    return F.when(of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.col(a), F.col(b))) / of)


def number_of_range(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most x."""
    if not bounds:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    return F.coalesce(F.size(F.filter(array, lambda b: b <= x)), F.lit(0))


def ranged_by_id(spark: SparkSession, docs: DataFrame, per_range: int, most: int = 500_000) -> DataFrame:
    """docs with `range`: numbers, rising with the ids, of ranges of about per_range documents, or of a `most`-th of all where that is more.

    Quantiles of all ids bound coarse ranges, quantiles inside each its fine ones. An id with the rows of two ranges has
    ranges of its own, and so have null ids; their rows are dealt over these by their place in the input.
    """
    n = docs.count()
    per_range = max(per_range, n // most)
    parts = max(1, n // per_range)
    coarse = max(1, int(parts**0.5))
    fine = -(-parts // coarse)
    quantiles = lambda k: F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], max(10_000, 5 * k))
    bounds = sorted(set((docs.agg(quantiles(coarse)).first()[0] or []) if n else []))
    docs = docs.withColumn("_coarse", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(number_of_range(F.col("doc_id"), bounds)))
    # fewer than `most` / 20 ids
    hot = docs.groupBy("_coarse", "doc_id").count().where(F.col("count") > F.lit(max(2 * per_range, 20 * n // most)))
    hot = save(spark, hot.select("_coarse", F.col("doc_id").alias("_hot"), F.ceil(F.col("count") / per_range).alias("_parts")), "hot-ids")
    own = F.flatten(F.collect_list(F.when(F.col("_hot") < (1 << 63) - 1, F.array("_hot", F.col("_hot") + 1)).otherwise(F.array("_hot"))))
    inner = docs.groupBy("_coarse").agg(quantiles(fine).alias("_inner")).join(hot.groupBy("_coarse").agg(own.alias("_own")), "_coarse", "left")
    inner = inner.select("_coarse", F.array_distinct(F.concat(F.coalesce("_inner", F.array().cast("array<bigint>")), F.coalesce("_own", F.array().cast("array<bigint>")))).alias("_bounds"))
    inner = save(spark, inner, "range-bounds")  # a row for each coarse range
    fine_number = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("doc_id"))), F.lit(0))
    docs = docs.join(F.broadcast(inner), "_coarse").withColumn("_fine", fine_number).drop("_bounds")
    docs = docs.join(F.broadcast(hot.drop("_coarse")), F.col("doc_id").eqNullSafe(F.col("_hot")), "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))).otherwise(F.lit(0))
    # one number: at most 708 coarse and 36,000 fine ranges, and fewer parts than 2 ** 28 at half a million rows each
    number = F.shiftleft(F.col("_coarse").cast("long") + 1, 48).bitwiseOR(F.shiftleft(F.col("_fine").cast("long"), 28)).bitwiseOR(part.cast("long"))
    return docs.withColumn("range", number).drop("_coarse", "_fine", "_hot", "_parts")


def fingerprints(spark: SparkSession, docs: DataFrame, per_range: int = 1000) -> DataFrame:
    """The fingerprint of each text and of its text edited with the next document's head.

    Ids are cut into ranges (see ranged_by_id); a range is a window, and what its last row needs from the next range is
    joined by the range's number, so that no task sees all rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = ranged_by_id(spark, docs, per_range).withColumn("tie", F.xxhash64("text"))
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie")
    tops = F.broadcast(ranged.groupBy("range").agg(F.max(place).alias("top")))  # a row for each range
    heads = ranged.join(tops, "range").where(place == F.col("top")).groupBy("range").agg(F.min("text").alias("head"))
    heads = save(spark, sketched(heads, "head", "head_sketch"), "range-heads")
    around = Window.orderBy(F.desc("range"))  # over the numbers of ranges alone
    links = heads.select("range", F.lead("range").over(around).alias("to"), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("highest"))
    nexts = links.select("range", F.coalesce("to", "highest").alias("to")).join(heads.withColumnRenamed("range", "to"), "to").drop("to")
    falling = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    rows = sketched(ranged, "text", "sketch").select("*", F.lead("text").over(falling).alias("next_text"), F.lead("sketch").over(falling).alias("next_sketch"))
    rows = rows.join(nexts, "range", "left").select("doc_id", "text", "sketch", F.coalesce("next_text", "head").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"), F.char_length("text").cast("long").alias("n_chars"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))).drop("text", "next_text")
    rows = sketched(rows, "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))
