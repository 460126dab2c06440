"""Queries of the subpackage on the smallest tables: SQL where there is some, else their contracts; the pipeline stage by stage."""

import os

import duckdb
import pytest

from folioscope.llm import mixing, neardup, quality, suffixes
from folioscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table[n].to_pylist() for n in names), strict=True)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(c.sql(ORACLE_SQL[name]).to_arrow_table())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = p.quality_rules(spark, docs, SF)
    kept = quality.apply_policy(quality.ledger(docs)).filter("kept")
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in kept.collect()} and got.columns == docs.columns
    near = p.near_dedup(spark, got, SF)
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in neardup.near_duplicates(spark, got).filter("kept").collect()}
    cut = p.suffix_dedup(spark, near, SF)
    assert cut.columns == docs.columns and cut.count() <= near.count()
    assert suffixes.repeats(spark, near).select("doc_id").distinct().count() == near.exceptAll(cut).count()
    mix = p.mix_sources(spark, cut, SF)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in mixing.mix(spark, cut).collect())
    packed = p.pack(spark, mix, SF)
    assert packed.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "packing"]
