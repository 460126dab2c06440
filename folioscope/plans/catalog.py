"""Seed tables: languages, entity definitions with their attributes, and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages in order of preference as a source.
LANGUAGES = [
    ("fr", "Français", "French", 1),
    ("en", "English", "American English (US)", 2),
    ("ru", "Русский", "Russian", 3),
]

# Entities of the published library reference model, then this engine's own; code, label, number in the model, table, parent.
DEFINITIONS = [
    ("res", "Res", "E1", None, None),
    ("work", "Work", "E2", None, None),
    ("expression", "Expression", "E3", "sources", None),
    ("manifestation", "Manifestation", "E4", None, None),
    ("item", "Item", "E5", None, None),
    ("agent", "Agent", "E6", None, None),
    ("person", "Person", "E7", None, "agent"),
    ("collective_agent", "Collective Agent", "E8", None, "agent"),
    ("nomen", "Nomen", "E9", None, None),
    ("place", "Place", "E10", None, None),
    ("time_span", "Time-span", "E11", None, None),
    ("source", "Source", None, "sources", None),
    ("page", "Page", None, "pages", None),
    ("chunk", "Chunk", None, "chunks", None),
    ("language", "Language", None, "languages", None),
    ("source_structure", "Source structure", None, "source_structure", None),
]

# Entity, attribute, type, required, repeatable.
ATTRIBUTES = [
    ("expression", "language", "text", True, False),
    ("expression", "title", "text", True, False),
    ("expression", "source_key", "text", True, False),
    ("manifestation", "carrier_type", "text", False, False),
    ("manifestation", "extent", "text", False, True),
    ("work", "has_form", "text", False, True),
    ("agent", "name", "text", True, False),
    ("page", "page_number", "int", True, False),
    ("page", "blocks", "jsonb", True, True),
    ("chunk", "chunk_text", "text", True, False),
    ("chunk", "embedding", "vector", True, False),
    ("language", "code", "text", True, False),
    ("language", "name", "text", True, False),
]

# Kind, subject, its part, predicate, object type, object.
RELATIONS = [
    ("external_mapping", "expression", "language", "equivalentTo", "dublin_core", "dc:language"),
    ("external_mapping", "expression", "title", "equivalentTo", "dublin_core", "dc:title"),
    ("association", "sources", "first", "hasAgent", "agent", "attributed author"),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "code string, name string, prompt_name string, ord int")


def definitions(spark: SparkSession) -> DataFrame:
    """Definitions with their parent's label: a self join."""
    d = spark.createDataFrame([(*x, i + 1) for i, x in enumerate(DEFINITIONS)], "code string, label string, model_entity string, maps_to string, parent string, ord int")
    p = d.select(F.col("code").alias("parent"), F.col("label").alias("parent_label"))
    return d.join(F.broadcast(p), "parent", "left")  # as many rows as the constant above


def attributes(spark: SparkSession) -> DataFrame:
    """Attributes of known entities, by an equi-join on the code."""
    a = spark.createDataFrame(ATTRIBUTES, "entity string, attribute string, data_type string, required boolean, repeatable boolean")
    d = definitions(spark).select(F.col("code").alias("entity"), "label")
    return a.join(F.broadcast(d), "entity").select(F.concat_ws(".", "entity", "attribute").alias("code"), "label", "data_type", "required", "repeatable")


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "kind string, subject string, part string, predicate string, object_type string, object string")


def integrity_faults(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``fault, guid``: rows that break the rules a database would enforce: owners, parents, unique keys."""
    fault = lambda df, name: df.select(F.lit(name).alias("fault"), F.col("guid").cast("string").alias("guid"))
    twice = lambda df, *keys: df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), list(keys), "left_semi")
    own, of = sources.select(F.col("guid").alias("owner")), pages.select(F.col("guid").alias("parent"))
    return (
        fault(sources.filter("owner IS NULL OR owner <> guid"), "source doesn't own itself")
        .unionByName(fault(twice(sources, "source_key", "language"), "source key and language twice"))
        .unionByName(fault(pages.join(own, "owner", "left_anti"), "page without a source"))
        .unionByName(fault(twice(pages, "owner", "page"), "page number twice"))
        .unionByName(fault(chunks.join(of, "parent", "left_anti"), "chunk without a page"))
        .unionByName(fault(twice(chunks, "parent", "ord"), "chunk order twice"))
    )
