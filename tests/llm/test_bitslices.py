import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import bitslices as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    big_n, big_l = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += terms(t)
    out = set()
    for item, ts in asked.items():
        scores = []
        for at, (doc, own) in enumerate(held):
            tf, m = Counter(own), 75 + 25 * len(own) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in ts if tf[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, at, doc))
        out |= {(item, rank, x[-1], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)}
    return out


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "'t' AS term").repartition(parts)
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS score", "'x' AS times")


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Étude", "niño", "a-b", "x_y", "日本", "A1", "3.5"]
    pick = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, pick(rng.randint(1, 60))) for i in range(150)] + [(200 + i, "w7 w9 copy") for i in range(40)]
    docs += [(300, None), (301, ""), (302, "-- !!"), (None, "w7 w9 copy"), (None, None), (5, "w7 w9"), (5, "w7 w9"), (303, " ".join(f"u{i}" for i in range(30_000)) + " w1"), (304, "w1 " * 5000)]
    items = [(i, pick(12)) for i in range(25)] + [(90, None), (91, ""), (92, "nothing known"), (93, "W7 copy " * 9), (None, "w9 W1"), (94, "étude ÉTUDE Étude"), (95, "w3"), (95, "w4 w3"), (96, pick(3000))]
    return docs, items


@pytest.mark.parametrize("layout", [B.Layout(), B.Layout(documents=16, postings=300, items=4, lanes=128)])
def test_same_as_brute_force(spark, layout):
    docs, items = made()
    d, i = frames(spark, docs, items)
    got = B.search(spark, B.index(spark, d, layout), i, layout=layout).collect()
    want = brute(docs, items)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rows_that_share_id_and_score_are_both_found(spark):
    docs = [(7, "only here"), (7, "only here"), (8, "other"), (9, "more")]
    d, i = frames(spark, docs, [(1, "here")])
    got = B.search(spark, B.index(spark, d), i).collect()
    assert [(r.rank, r.doc_id) for r in got] == [(1, 7), (2, 7)]


def test_empty_tables(spark):
    docs, items = made()
    d, i = frames(spark, docs, items)
    none, nothing = frames(spark, [], [])
    assert B.search(spark, B.index(spark, none), i).count() == 0
    assert B.search(spark, B.index(spark, d), nothing).count() == 0
    empty, _ = frames(spark, [(1, None), (2, "")], [])
    assert B.search(spark, B.index(spark, empty), i).count() == 0


def test_index_holds_every_term(spark):
    docs, _ = made()
    d, _ = frames(spark, docs, [])
    rows = B.index(spark, d, B.Layout(documents=16, postings=300))
    df = {bytes(r.term).decode(): r.df for r in rows.filter("term IS NOT NULL").groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "df").collect()}
    assert df == Counter(t for _, x in docs for t in set(terms(x)))
    ids = rows.filter("term IS NULL").select("n", "ids").collect()
    assert sorted(str(x) for r in ids for x in r.ids) == sorted(str(i) for i, _ in docs) and max(r.n for r in ids) <= 16


def slices_of(values):
    width = -(-len(values) // 64) * 64
    padded = np.zeros(width, np.int64)
    padded[: len(values)] = values
    return [np.packbits((padded >> s & 1).astype(np.uint8), bitorder="little").view(np.uint64) for s in range(45)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**20), st.integers(0, 2**20)), min_size=1, max_size=150), st.integers(0, 9))
def test_carry_arithmetic(pairs, shift):
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    total = slices_of(a)[:21]
    B.add_into(total, slices_of(b)[:21], shift)
    places, values = B.best(total, len(a))
    want = a + (b << shift)
    assert (places == np.flatnonzero(want)).all() and (values == want[places]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=200), st.integers(1, 30))
def test_best_from_the_highest_slice(values, k):
    places, found = B.best(slices_of(np.array(values)), k)
    want = sorted((i for i, v in enumerate(values) if v), key=lambda i: (-values[i], i))[:k]
    assert places.tolist() == sorted(want) and found.tolist() == [values[i] for i in sorted(want)]
