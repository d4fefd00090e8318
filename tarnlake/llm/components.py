"""Connected components of a graph given as (child, parent) links with parent < child."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, save


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(child, parent) with the smallest node that each non-smallest node reaches.

    Each round hangs every further parent of a node below the node's smallest parent and then replaces parents by
    their own parents. It ends when neither step changes a link. The links of a round are a table in the shared folder.
    The many children of one parent and the many parents of one child are looked up without meeting in one task.
    """
    at = save(spark, links.select("child", "parent").distinct(), "links")
    while True:
        least = at.groupBy("child").agg(F.min("parent").alias("least"))
        least = save(spark, least, "least")
        more = looked_up(spark, at.select("child", "parent"), least, ["child"]).where("parent > least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        both = save(spark, least.select("child", F.col("least").alias("parent"), F.lit(False).alias("moved")).unionByName(more.distinct().withColumn("moved", F.lit(True))), "hung")
        up = save(spark, both.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("above")), "above")
        jumped = looked_up(spark, both, up, ["parent"], "left").select("child", F.coalesce("above", "parent").alias("parent"), (F.col("moved") | F.col("above").isNotNull()).alias("moved"))
        at = save(spark, jumped.groupBy("child", "parent").agg(F.max("moved").alias("moved")), "links")
        if not at.where("moved").limit(1).count():
            return at.select("child", "parent")
