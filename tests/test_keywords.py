"""Phrases, required and excluded words, cover density; stored postings against the scan."""

import re

import pytest
from pyspark.sql import functions as F

from folioscope.operators import keywords as K
from folioscope.operators import search


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, i % 2, "en" if i % 3 else "fr") for i, t in enumerate(rows)], "guid int, text string, owner int, language string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, text string")


def found(df):
    return [(r.query_id, r.guid, round(r.text_rank, 9)) for r in df.orderBy("query_id", "rank").collect()]


def test_clauses(spark):
    rows = K.clauses(asked(spark, 'Protein "king of Spain" -fat OR g/kg or -"dry bread" the', "the -of", "", None)).orderBy("query_id", "item", "off").collect()
    assert [(r.grp, r.item, r.negated, r.off, r.term, r.n) for r in rows] == [
        (0, 0, False, 0, "protein", 1), (0, 1, False, 0, "king", 2), (0, 1, False, 2, "spain", 2), (0, 2, True, 0, "fat", 1), (1, 4, False, 0, "g", 2), (1, 4, False, 1, "kg", 2), (2, 6, True, 0, "dri", 2), (2, 6, True, 1, "bread", 2),
    ]


CORPUS = ("alpha beta gamma", "alpha x x beta", "beta alpha", "alpha of gamma beta alpha", None, "", "delta", "alpha the gamma", "alpha alpha x beta beta", "gamma delta")


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("alpha beta", [(3, 0.1 + 0.1 / 3), (0, 0.1), (2, 0.1), (8, 0.05), (1, 0.1 / 3)]),
        ('"alpha beta"', [(0, 0.1)]),
        ('"alpha of gamma"', [(0, 0.05), (3, 0.05), (7, 0.05)]),
        ("alpha -beta", [(7, 0.1)]),
        ("alpha or gamma", [(3, 0.3), (0, 0.2), (7, 0.2), (8, 0.2), (1, 0.1), (2, 0.1), (9, 0.1)]),
        ("delta or alpha gamma -beta", [(6, 0.1), (9, 0.1), (7, 0.05)]),
        ("-alpha", []),
        ('-"alpha beta" alpha beta', [(3, 0.1 + 0.1 / 3), (2, 0.1), (8, 0.05), (1, 0.1 / 3)]),
        ("unheard", []),
    ],
)
def test_matches_and_ranks(spark, question, want):
    got = found(K.phrase_search(texts(spark, *CORPUS), asked(spark, question), 20))
    assert [(g, r) for _, g, r in got] == [(g, round(r, 9)) for g, r in want]


def test_covers_overlap_and_count_once(spark):
    # places 0..6: a b x a c b a; covers of a and b: (0,1), (1,3) with one word of noise, (3,5) whose c is noise, (5,6)
    got = found(K.phrase_search(texts(spark, "aa bb xx aa cc bb aa"), asked(spark, "aa bb"), 5))
    assert got == [(0, 0, round(0.1 + 0.05 + 0.05 + 0.1, 9))]


def test_alternatives_alone_are_the_plain_search(spark):
    rows = texts(spark, *CORPUS)
    plain = search.keyword_search(rows, search.terms_of(asked(spark, "alpha or gamma or delta")), 20)
    assert found(K.phrase_search(rows, asked(spark, "alpha or gamma or delta"), 20)) == found(plain)


def test_filters_and_a_given_index(spark):
    rows = texts(spark, *CORPUS)
    index = K.positions(rows).join(rows.select("guid", "owner", "language"), "guid")
    for owner, language in ((1, None), (None, "fr"), (0, "en")):
        a, b = (found(K.phrase_search(r, asked(spark, "alpha beta or delta"), 20, owner, language, i)) for r, i in ((rows, None), (None, index)))
        assert a == b and a


def corpus(spark, n=1500):
    """Texts of very different lengths; words of very different frequency."""
    word = F.concat(F.lit("w"), F.floor(F.pow(F.pmod(F.xxhash64("id", "i"), F.lit(1000)) / 1000.0, 3.0) * 80).cast("string"))
    length = F.when(F.col("id") % 50 == 0, 400).when(F.col("id") % 7 == 0, 60).otherwise(8)
    each = spark.range(n).withColumn("i", F.explode(F.sequence(F.lit(1), length))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text"))
    return each.select(F.col("id").alias("guid"), (F.col("id") % 3).alias("owner"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("language"), "text")


def test_stored_postings_equal_the_scan_and_skip_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    rows = corpus(spark)
    folder = K.build_postings(rows, str(tmp_path / "p"))
    terms = search.terms_of(asked(spark, "w3 w10", "w0", "w79 w78 w77", "unheard", "w5 w6 w7 w8 w1 w2"))
    for owner, language, k in ((None, None, 10), (1, None, 10), (None, "fr", 50), (2, "en", 3)):
        want = found(search.keyword_search(rows, terms, k, owner, language))
        assert found(K.stored_search(spark, folder, terms, k, owner, language)) == want and want
    bounds, first = K._first_blocks(spark, folder, terms)
    scored = K._scored(spark, folder, terms, first, None, None)
    least = {r.query_id: sorted((x.n for x in scored.filter(F.col("query_id") == r.query_id).collect()), reverse=True)[9] for r in scored.groupBy("query_id").count().filter("count >= 10").collect()}
    last = spark.createDataFrame(list(least.items()), "query_id int, least long")
    rest = K._other_blocks(bounds, first, last)
    assert first.count() + rest.count() < 0.7 * bounds.count()  # the others' postings aren't read


def test_no_texts_no_terms(spark, tmp_path):
    folder = K.build_postings(texts(spark, None, "", "the of"), str(tmp_path / "p"))
    assert K.stored_search(spark, folder, search.terms_of(asked(spark, "alpha"))).isEmpty()
    folder = K.build_postings(texts(spark, *CORPUS), str(tmp_path / "q"))
    assert K.stored_search(spark, folder, search.terms_of(asked(spark, "the", None))).isEmpty()


def test_places_stay_where_texts_are_dealt(spark, monkeypatch):
    chunks = texts(spark, *CORPUS)
    q = spark.createDataFrame([(1, '"alpha beta" or delta gamma'), (2, "alpha -delta"), (3, "beta gamma")], "query_id long, text string")
    found = K.phrase_search(chunks, q, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*(grp|item|want|term|word)#", plan)
    want = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(K.search, "SENT", 0)  # as where questions have too many words to be sent
    assert sorted(map(tuple, K.phrase_search(chunks, q, 5).collect())) == want
