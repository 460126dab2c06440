"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each source's target is its share by weight of all words times ``share``; a target stops at ``most`` times its source's
size, and what is above is shared again by weight until no target is above.  Every document of a source then expects
target / size copies; with a random start ``u`` in [0, 1), a document is taken once for each whole number that the
running sum of expected copies passes.  Documents stand in order of size, so each start takes short and long ones alike
and the words taken stay near the target.

The running sum is made in two passes: rows are dealt by range of (source, size, id), each partition counts its rows,
and the counts' prefix sums are added to row numbers within the partition.  So no task holds a source.

Defined cases: null texts have size 0; documents without words are never taken; a null source is a source, the last in
order; a null id stands before others; equal rows count separately; rows with equal source, size and id stand in the
order of their contents' hashes, so reruns agree; very long texts are one document like others; an empty table gives an
empty result; other columns are left out of the plan (``mixture``) or carried along (``mixed``), whatever their names.

Sums over sources' and partitions' totals run in one task each: a row for each source, or for each source and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, partitions, row_hash, staged, word_count

WEIGHTS = (5, 2, 1)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: one row for each source, water-filled.

    With sources in order of cap / weight, the first so many are at their caps, and the rest share what these leave;
    the level is the least for which the next source's cap isn't reached.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return (
        totals.withColumn("w", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("at_cap", F.col("cap") <= F.col("level") * F.col("w"))
        # the first source below its cap has the level that holds; those after it have lower ones
        .withColumn("level", F.max(F.when(~F.col("at_cap"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))))
        .select("source", "source_size", "target")
    )


def start_of(source: Column, seed: int) -> Column:
    """The source's random start in [0, 1): fixed by its name and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixture(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, tie`` to the same with ``source_size, target, copies, taken``; ``tie`` orders rows that are equal in the rest."""
    n = max(partitions(spark), 1)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("tie")]
    dealt = sizes.select("doc_id", "source", "size", "tie").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    # numbers of partitions must not change if a task runs again elsewhere
    rows = staged(spark, dealt, "mix")
    per_part = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    per_source = targets(per_part.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    p = per_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("p")
    s = per_source.alias("s")
    plan = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source"))).select(F.col("p.source").alias("of"), F.col("p.part").alias("at"), "source_size", "target", "before")
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id", "tie"))
    numbered = rows.withColumn("rank", rank)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = numbered.join(plan, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    r = F.col("rank") + F.col("before")
    copies = F.floor(F.col("start") + r * F.col("rate")) - F.floor(F.col("start") + (r - 1) * F.col("rate"))
    return (
        joined.withColumn("rate", rate)
        .withColumn("start", start_of(F.col("source"), seed))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "tie", "source_size", "target", "copies", "taken")
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), word_count("text").alias("size"), row_hash(docs).alias("tie"))


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixture's plan for each document of ``docs``."""
    return mixture(spark, sizes_of(docs), **how).drop("tie")


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row as many times as it is taken.

    Rows that are equal in every column stand for each other: one of them is repeated as often as all are taken.
    """
    plan = mixture(spark, sizes_of(docs), **how).groupBy(_key().alias("key")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = carried(docs, F.col("doc_id"), F.col("source"), word_count("text").alias("size"), row_hash(docs).alias("tie")).select("row", _key().alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    once = rows.join(plan, "key").withColumn("nth", nth).filter("nth = 1")
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _key() -> Column:
    """One value for a row's id, source, size and content; without nulls, so that window and join deal rows alike."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.md5(F.concat_ws("\x01", part("doc_id"), part("source"), part("size"), part("tie")))
