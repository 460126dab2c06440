"""Exact dense search in blocks, and the index of inverted lists: recall, filters, insertion, many questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import dense, search


def made(spark, n, seed=1, clusters=40, d=24):
    """Unit vectors in clusters, of three owners and two languages; some rows can't be compared."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d))
    v = centre[rng.integers(0, clusters, n)] + 0.5 * rng.normal(size=(n, d))
    rows = [(i, i % 3, "en" if i % 2 else "fr", x.tolist()) for i, x in enumerate(v)]
    rows += [(n, 0, "en", None), (n + 1, 0, "en", [0.0] * d), (n + 2, 0, "en", [float("nan")] * d), (n + 3, 1, "en", [1.0, 2.0])]
    return spark.createDataFrame(rows, "guid long, owner int, language string, embedding array<double>").repartition(3), v


def brute(v, q, k, keep):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in q:
        d = 1 - u @ u[i]
        out[i] = [x for x in np.lexsort((np.arange(len(v)), np.round(d, 12))).tolist() if keep(x)][:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.guid)
    return out


def questions(chunks, ids):
    return chunks.filter(F.col("guid").isin(ids)).select(F.col("guid").alias("query_id"), F.col("embedding").alias("vector"))


@pytest.mark.parametrize("n", [900, 4000])
def test_recall_at_two_sizes(spark, tmp_path, n):
    chunks, v = made(spark, n)
    ids = list(range(0, n, n // 40))
    folder = dense.build_index(chunks, str(tmp_path / "i"), dense.Lists(probes=60))
    q = questions(chunks, ids)
    want = brute(v, ids, 20, lambda x: True)
    assert answers(search.dense_search(chunks, q, 20)) == want == answers(dense.index_search(spark, folder, q, 20, exact=True))
    got = answers(dense.index_search(spark, folder, q, 20))
    assert sum(len(set(got[i]) & set(want[i])) for i in ids) >= 0.9 * 20 * len(ids)
    lists = spark.read.parquet(f"{folder}/centroids").count()
    assert spark.read.parquet(f"{folder}/defaults").first().lists < lists / 2  # a search reads less than half
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/vectors").count() == n + 1  # every vector that can be compared, whatever its length


def test_filters_and_insertion(spark, tmp_path):
    chunks, v = made(spark, 600, clusters=30)
    old, new = chunks.filter("guid < 500 OR guid > 600"), chunks.filter("guid BETWEEN 500 AND 600")
    folder = dense.build_index(old, str(tmp_path / "i"), dense.Lists(lists=25, probes=40))
    before = spark.read.parquet(f"{folder}/centroids").collect()
    dense.insert(new, folder)
    assert spark.read.parquet(f"{folder}/centroids").collect() == before
    ids = [3, 77, 501, 599]
    q = questions(chunks, ids)
    for owner, language in ((1, None), (None, "fr"), (2, "en")):
        keep = lambda x: (owner is None or x % 3 == owner) and (language is None or ("en" if x % 2 else "fr") == language)  # noqa: E731, B023
        want = brute(v, ids, 10, keep)
        assert answers(dense.index_search(spark, folder, q, 10, owner, language, exact=True)) == want == answers(search.dense_search(chunks, q, 10, owner, language))
        some = dense.index_search(spark, folder, q, 10, owner, language, lists=1)  # a filter doesn't make a search come back short
        assert {i: len(x) for i, x in answers(some).items()} == {i: 10 for i in ids}
    two = spark.createDataFrame([(-1, [2.0, 4.0]), (-2, [1.0])], "query_id long, vector array<double>")
    assert answers(dense.index_search(spark, folder, two, 3)) == {-1: [603]}
    assert dense.index_search(spark, folder, q, 5, owner=9).isEmpty() and dense.index_search(spark, folder, q.limit(0), 5).isEmpty()


def test_small_and_empty_indexes(spark, tmp_path):
    chunks, _ = made(spark, 1)
    none = dense.build_index(chunks.limit(0), str(tmp_path / "none"))
    one = dense.build_index(chunks.filter("guid = 0"), str(tmp_path / "one"))
    q = questions(chunks, [0])
    dense._listed(chunks.filter("guid = 0"), np.eye(1, 24)).write.partitionBy("list").parquet(f"{one}/vectors/batch=broken")  # never finished
    assert dense.index_search(spark, none, q, 5).isEmpty() and answers(dense.index_search(spark, one, q, 5)) == {0: [0]}
    dense.insert(chunks.filter("guid = 0").withColumn("guid", F.lit(8).cast("long")), one)
    assert answers(dense.index_search(spark, one, q, 5)) == {0: [0, 8]}


def test_many_questions_are_dealt(spark, monkeypatch):
    chunks, v = made(spark, 300)
    many = spark.range(20_001).select(F.col("id").alias("query_id"), (F.col("id") % 300).alias("guid")).join(chunks, "guid").select("query_id", F.col("embedding").alias("vector"))
    monkeypatch.setattr(dense, "SLOT", 70)
    got = answers(search.dense_search(chunks, many, 3))
    want = brute(v, range(300), 3, lambda x: True)
    assert len(got) == 20_001 and all(got[i] == want[i % 300] for i in got)


def test_equal_vectors_stand_by_guid(spark):
    rows = [(i, [0.1 * (1 + i % 2), 0.3 * (1 + i % 2), 0.7 * (1 + i % 2)]) for i in range(3000)] + [(None, [0.1, 0.3, 0.7])]
    chunks = spark.createDataFrame(rows, "guid long, embedding array<float>").repartition(7)
    q = spark.createDataFrame([("q", [1.0, 2.0, 3.0])], "query_id string, vector array<double>")
    assert answers(search.dense_search(chunks, q, 50)) == {"q": list(range(50))}
