"""Held-out accuracy on made texts, and the defined cases."""

import random
import zlib

import pytest

from folioscope.llm import toxicity

BAD = ["scoundrel", "nitwit", "rotten egg", "blockhead"]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lo mi nu ra se ti va".split()]
    rows, labels = [], []
    for i in range(900):
        t = [r.choice(words) for _ in range(r.randrange(20, 120))]
        toxic = i % 5 == 0
        for _ in range(r.randrange(2, 5) if toxic else 0):
            t.insert(r.randrange(len(t)), r.choice(BAD))
        rows.append((i, " ".join(t)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (-1, None), (-2, ""), (None, "nitwit")], "doc_id long, text string").selectExpr("*", "'x' score", "1 toxic")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark, made):
    docs, labels = made
    got = {r.doc_id: r for r in toxicity.scored(spark, docs, labels).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(900))
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert not got[-1].predicted and not got[-2].predicted


def test_labels_of_the_held_out_are_not_read(spark, made):
    from pyspark.sql import functions as F

    docs, labels = made
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda l: sorted((r.doc_id or -9, r.score) for r in toxicity.scored(spark, docs, l).collect())  # noqa: E731, E741
    assert rows(labels) == rows(other)


def test_edges(spark, made):
    docs, labels = made
    assert {r.score for r in toxicity.scored(spark, docs.limit(5), labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.scored(spark, docs.limit(0), labels).isEmpty()
