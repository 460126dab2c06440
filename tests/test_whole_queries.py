"""Queries over whole tables against DuckDB: no row and no part of a text is left out."""

import os

import duckdb
import pytest

from folioscope.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def same(spark, name, sql):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, wanted = QUERIES[name](spark, SF).toArrow(), c.sql(sql).to_arrow_table()
    assert got.column_names == wanted.column_names and sorted(map(repr, got.to_pylist())) == sorted(map(repr, wanted.to_pylist()))
    return got.num_rows, c


def test_text_functions_over_all_pages_and_documents(spark):
    titles, c = same(spark, "page_titles", r"""SELECT page_id, CASE WHEN s = '' THEN 'source' ELSE s END AS slug, md5(t) AS title_md5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, trim(regexp_replace(translate(html, '<>/', '   '), '\s+', ' ', 'g')) AS t FROM pages)""")
    cut, _ = same(spark, "cut_texts", r"""SELECT doc_id, (CASE WHEN length(text) <= 1000 THEN length(text) ELSE length(regexp_replace(text[1:1000], '\s+$', '')) + 40 END)::INT AS cut_chars FROM documents""")
    assert [(titles, cut)] == c.sql("SELECT (SELECT count(*) FROM pages), (SELECT count(*) FROM documents)").fetchall()


def test_translation_targets_of_documents_of_any_length(spark):
    n, _ = same(spark, "translation_targets", """WITH p AS (SELECT DISTINCT source AS source_key, lang AS language FROM documents), l(language, ord) AS (VALUES ('fr', 1), ('en', 2), ('de', 3), ('es', 4), ('ru', 5)),
s AS (SELECT source_key, arg_min(language, ord) AS source_language FROM p JOIN l USING (language) GROUP BY source_key)
SELECT source_key, l.language, source_language FROM s, l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_key = s.source_key AND p.language = l.language)""")
    every = {(r.source_key, r.language) for r in QUERIES["translation_targets"](spark, SF).collect()}
    docs = {(r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert n == len(every) and not every & docs
