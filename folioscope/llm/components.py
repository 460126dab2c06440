"""Connected components of a table of links, in rounds of joins and partial aggregations (large star, small star).

No component is gathered anywhere: a hub's row meets its neighbours in a join that Spark may split.

Defined cases: links with a null end, and of an id with itself, are no links; repeated links count once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(spark: SparkSession, links: DataFrame, rounds: int = 40) -> DataFrame:
    """``a, b`` (ids, in either order) to ``id, component``: the least id that each id reaches. Ids without links have no row."""
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges = staged(spark, links.filter("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = staged(spark, small.unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        drop_staged(spark, edges)
        edges = step
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = ids.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out._folioscope_path = edges._folioscope_path  # so that drop_staged knows what it reads
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star about its least id: each id points to one other at most, and none is pointed to that points on."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()
