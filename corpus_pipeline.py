"""The corpus pipeline: five stages, each on all that the one before kept.

Defined cases, for all stages: an empty table gives an empty one; columns come through as they are, whatever their names;
repeated rows are rows of their own; very long texts are taken whole; ties fall to the least id, then to the rows' contents,
so reruns agree.  What nulls give is said with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import mixing, neardup, packing, quality, suffixes, tokens
from folioscope.llm.common import drop_staged, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps. A null text has no words and goes; other nulls play no part."""
    return quality.keep_good(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near duplicates. Rows with a null id, and texts without words, all stay; rows that share an id stay or go together."""
    return neardup.deduplicated(spark, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand earlier in the corpus are cut out; texts with no word left go. Rows with a null id or text stay as they are."""
    return suffixes.without_repeats(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. A null source is a source; a null text has no words and is never taken."""
    return mixing.mixed(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids: their pieces, with what is needed to find and to check them. A null text is the end id alone; a null id stays null."""
    return packing.packed(spark, docs, tokens.public_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Near duplicates and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(spark, stage(spark, docs, sf_dir), name)
        drop_staged(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
