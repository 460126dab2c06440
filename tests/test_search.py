"""Fusion, reranking, overrides, expansion, context: hand-made lists with known results."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import lexemes
from folioscope.operators import search


def ranked(spark, guids, extra=""):
    return spark.createDataFrame([(0, g, i + 1) for i, g in enumerate(guids)], "query_id int, guid string, rank int")


def by_rank(df):
    return [r.guid for r in df.orderBy("rank").collect()]


def test_rrf_order_ranks_and_ties(spark):
    out = search.rrf({"dense": ranked(spark, ["g1", "g2", "g3"]), "keyword": ranked(spark, ["g4", "g2", "g3"])})
    rows = {r.guid: r for r in out.collect()}
    assert by_rank(out) == ["g2", "g3", "g1", "g4"]
    assert rows["g2"].rrf_score == pytest.approx(2 / 62) and rows["g3"].rrf_score == pytest.approx(2 / 63)
    assert (rows["g1"].keyword_rank, rows["g4"].dense_rank, rows["g2"].dense_rank) == (None, None, 2)


def test_rrf_empty_list(spark):
    assert by_rank(search.rrf({"a": ranked(spark, ["x"]), "b": ranked(spark, ["x"]).limit(0)})) == ["x"]


def test_multi_query_prefers_agreement(spark):
    rows = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1)], "question_id int, sub int, guid string, rank int")
    assert by_rank(search.multi_query(rows)) == ["b", "a"]


def test_rerank(spark):
    rows = ranked(spark, ["g1", "g2", "g3"])
    score = F.when(F.col("guid") == "g2", 0.95).when(F.col("guid") == "g1", 0.4).otherwise(0.1)
    out = search.rerank(rows, score)
    first = out.orderBy("rank").first()
    assert (first.guid, first.rerank_score, first.retrieval_rank) == ("g2", 0.95, 2)
    assert by_rank(search.rerank(rows, score, 1)) == ["g2"] and search.rerank(rows.limit(0), score).count() == 0


def test_override(spark):
    rows = ranked(spark, ["g1", "g2", "g3"]).withColumn("cosine_distance", F.lit(0.2))
    by_hand = spark.createDataFrame([("g3", 0.99, "best")], "guid string, manual_rank_score double, manual_rank_reason string")
    out = search.override(rows, by_hand)
    assert by_rank(out) == ["g3", "g1", "g2"] and out.filter("guid = 'g3'").first().manual_rank_reason == "best"
    with pytest.raises(ValueError):
        search.check_known(rows, "nobody")


def test_override_keeps_all_rows_of_a_large_table(spark):
    n = search.MAX_QUERIES + 500
    rows = spark.range(n).select(F.lit(0).alias("query_id"), F.col("id").alias("guid"), (F.col("id") + 1).cast("int").alias("rank"))
    by_hand = spark.range(n).select(F.col("id").alias("guid"), (F.col("id") / 4).alias("manual_rank_score"), F.lit("by hand").alias("manual_rank_reason"))
    out = search.override(rows, by_hand)
    assert out.filter("manual_rank_score is null").isEmpty() and out.count() == n
    assert out.filter("rank = 1").first().guid == n - 1


def test_expand(spark):
    rows = spark.createDataFrame([(0, "g1", "p1", 1, "a"), (0, "g2", "p1", 2, "b"), (0, "g3", "gone", 3, "c")], "query_id int, guid string, parent string, rank int, text string")
    pages = spark.createDataFrame([("p1", "page one " * 5)], "guid string, text string")
    got = search.expand_to_pages(rows, pages, 20).orderBy("rank").collect()
    assert [(r.guid, r.matched_children, r.expanded_from_parent) for r in got] == [("g1", ["g1", "g2"], True), ("g3", ["g3"], False)]
    assert got[0].text == "page one page one pa" + "\n\n...[parent chunk truncated for length]" and got[1].text == "c"


def test_context(spark):
    rows = spark.createDataFrame([(0, 2, "s", "b", 0.5), (0, 1, "s", "a", 0.951)], "query_id int, rank int, source_key string, text string, rerank_score double")
    assert search.context_block(rows).first().context == "[Excerpt 1 -- s | relevance 0.95]\na\n\n[Excerpt 2 -- s | relevance 0.50]\nb"


def test_dense_skips_null_vectors_and_caps(spark):
    chunks = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(70)] + [(99, None)], "guid long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    out = search.dense_search(chunks, q, 100)
    assert out.count() == search.MAX_ROWS and out.orderBy("rank").first().guid == 0
    assert [r.guid for r in search.dense_search_one(chunks, [1.0, 0.0], 3).orderBy("rank").collect()] == [0, 1, 2]


@given(st.text())
def test_or_query(q):
    out = search.or_query(q)
    assert out == q or all(w and w[0] not in "?!.," for w in out.split(" OR "))


def test_or_query_examples():
    assert search.or_query("How many g/kg, 0.8?") == "How OR many OR g/kg OR 0.8" and search.or_query("??") == "??"
    assert search.pool(5) == 20 and search.pool(1) == 15


def asked(spark, *questions):
    return search.terms_of(spark.createDataFrame(list(enumerate(questions)), "query_id int, text string"))


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "guid int, text string")


def test_keyword_search_drops_noise_and_keeps_numbers(spark):
    chunks = texts(spark, "the the the the of of to", "0.8 g/kg of protein", "nothing here")
    got = search.keyword_search(chunks, asked(spark, "What is the RDA of protein, 0.8 g/kg?")).collect()
    assert [(r.guid, r.rank, round(r.text_rank, 9)) for r in got] == [(1, 1, 0.4)]
    assert search.keyword_search(chunks, asked(spark, "what is it?")).isEmpty()


def test_keyword_search_stems_and_knows_other_scripts(spark):
    chunks = texts(spark, "Proteins were recommended", "Сколько белка нужно взрослому", "un café crème")
    terms = asked(spark, "recommending protein", "сколько белка?", "Café!")
    assert sorted((r.query_id, r.guid) for r in search.keyword_search(chunks, terms).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(map(tuple, search.keyword_search(None, terms, index=search.postings(chunks)).collect())) == sorted(map(tuple, search.keyword_search(chunks, terms).collect()))


def test_dense_search_takes_only_sound_vectors(spark):
    chunks = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, None), (4, [2.0, 0.0])], "guid int, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.query_id, r.guid, r.cosine_distance) for r in search.dense_search(chunks, q, 5).orderBy("rank").collect()] == [("a", 0, 0.0), ("a", 4, 0.0)]
    assert search.dense_search(chunks, q.limit(0), 5).isEmpty()


def test_expansion_keeps_chunks_without_a_parent_apart(spark):
    rows = spark.createDataFrame([(0, "g1", None, 1, "a"), (0, "g2", None, 2, "b")], "query_id int, guid string, parent string, rank int, text string")
    got = search.expand_to_pages(rows, spark.createDataFrame([("p", "x")], "guid string, text string")).orderBy("rank").collect()
    assert [(r.guid, r.text, r.expanded_from_parent) for r in got] == [("g1", "a", False), ("g2", "b", False)]


def test_of_several_overrides_the_highest_holds(spark):
    by_hand = spark.createDataFrame([("g1", 0.1, "x"), ("g1", 0.7, "y")], "guid string, manual_rank_score double, manual_rank_reason string")
    assert [r.manual_rank_score for r in search.override(ranked(spark, ["g1"]), by_hand).collect()] == [0.7]


def _dealt_by(df):
    """The columns by which a plan deals rows out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {tuple(re.findall(r"(\w+)#\d+", x)) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)}


def test_texts_are_counted_where_they_are_dealt(spark, monkeypatch):
    """Neither occurrences of words nor counts of pairs move; rare words' stems are found where they stand."""
    texts = [(i, "o", "en", f"running runs w{i}ing cats the cat word{i % 3}s") for i in range(40)]
    chunks = spark.createDataFrame(texts, "guid long, owner string, language string, text string")
    terms = search.terms_of(spark.createDataFrame([(1, "cat run"), (2, "word1s w7ing")], "query_id long, text string"))
    found = search.keyword_search(chunks, terms, 50)
    assert _dealt_by(found) == {("guid",), ("query_id",)} and found.count() == 40 + 13
    assert _dealt_by(search.postings(chunks, "language")) == {("guid",), ("word",)}
    every = sorted(map(tuple, search.postings(chunks, "owner").collect()))
    monkeypatch.setattr(lexemes, "COMMON", 1)
    assert sorted(map(tuple, search.postings(chunks, "owner").collect())) == every
    monkeypatch.setattr(search, "SENT", 0)
    assert sorted(map(tuple, search.keyword_search(chunks, terms, 50).collect())) == sorted(map(tuple, found.collect()))


def test_postings_of_texts_that_share_a_guid(spark):
    """Each text's words count with its own owner, as in a search of texts."""
    chunks = spark.createDataFrame([(1, "a", "en", "cat cat"), (1, "b", "en", "cat"), (2, "a", "en", "dog")], "guid long, owner string, language string, text string")
    terms = search.terms_of(spark.createDataFrame([(1, "cat")], "query_id long, text string"))
    index = search.postings(chunks, "owner")
    for owner in ("a", "b", None):
        by_text = [tuple(r) for r in search.keyword_search(chunks, terms, owner=owner).collect()]
        assert by_text and [tuple(r) for r in search.keyword_search(None, terms, owner=owner, index=index).collect()] == by_text


def test_hybrid_search_reads_texts_apart(spark):
    docs = spark.createDataFrame([(i, "cat " * i) for i in range(1, 6)], "guid long, text string")
    chunks = docs.join(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 4)], "guid long, embedding array<double>"), "guid", "left")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    terms = search.terms_of(spark.createDataFrame([(1, "cats")], "query_id long, text string"))
    assert sorted(map(str, search.hybrid_search(chunks, q, terms, texts=docs).collect())) == sorted(map(str, search.hybrid_search(chunks, q, terms).collect()))
