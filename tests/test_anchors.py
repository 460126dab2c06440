"""Anchors of titles: garbled letters, repeated lines, titles out of order; chains against brute force."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioscope.operators import anchors as A

LEVEL = "doc int, idx int, page int, off int, score int"


def frames(spark, pages, titles):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(pages)], "doc string, page int, text string"), spark.createDataFrame([("b", i, t) for i, t in enumerate(titles)], "doc string, idx int, title string")


def test_titles_in_order(spark):
    pages = ["Contents\nThe Origin of Things\nOn Matter\nOn Minds", "x\n\nThe 0rigin of Thing5\ntext text", None, "", "On Matter\nThe Origin of Things again and again, as a very long line that only cites it\nOn Mind", "On Matter"]
    titles = ["The Origin of Things", "On Matter", "On Minds", "Unheard of", None, "?"]
    got = {r.idx: (r.page, r.off) for r in A.anchors(*frames(spark, pages, titles)).collect()}
    assert got == {0: (0, 9), 1: (0, 30), 2: (0, 40)}  # a whole chain in the contents
    body = {r.idx: (r.page, r.off) for r in A.anchors(*frames(spark, ["", *pages[1:]], titles)).collect()}
    assert body == {0: (1, 3), 1: (4, 0), 2: (4, 87)}
    ends = {r.idx: (r.end_page, r.end_off) for r in A.spans(A.anchors(*frames(spark, ["", *pages[1:]], titles))).collect()}
    assert ends == {0: (4, 0), 1: (4, 87), 2: (None, None)}


def test_a_title_that_stands_too_early_is_left_out(spark):
    got = {r.idx: r.page for r in A.anchors(*frames(spark, ["Third part", "First part", "Second part", "x"], ["First part", "Second part", "Third part"])).collect()}
    assert got == {0: 1, 1: 2}


def test_nothing(spark):
    pages, titles = frames(spark, ["a"], ["zzzz"])
    assert A.anchors(pages, titles).isEmpty() and A.anchors(pages.limit(0), titles).isEmpty() and A.anchors(pages, titles.limit(0)).isEmpty()


def best(cands):
    """The greatest sum over all chains."""
    top = 0
    for n in range(1, len(cands) + 1):
        for c in itertools.combinations(sorted(cands, key=lambda x: (x[1], x[2])), n):
            if all(a[0] < b[0] and (a[1], a[2]) < (b[1], b[2]) for a, b in itertools.pairwise(c)):
                top = max(top, sum(x[3] for x in c))
    return top


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 2), st.integers(700, 1000)), min_size=1, max_size=9, unique_by=lambda x: x[:3]))
def test_chains(spark, cands):
    got = A.best_chain(spark.createDataFrame([(1, *c) for c in cands], LEVEL)).collect()
    rows = sorted(((r.idx, r.page, r.off, r.score) for r in got))
    assert all(a[0] < b[0] and a[1:3] < b[1:3] for a, b in itertools.pairwise(rows)) and set(rows) <= set(cands)
    assert sum(r[3] for r in rows) == best(cands)


def test_lines(spark):
    pages, _ = frames(spark, ["ab\n\nc d\n?!", "\n"], [])
    assert [(r.page, r.off, r.text) for r in A.page_lines(pages).collect()] == [(0, 0, "ab"), (0, 4, "c d")]
    with pytest.raises(Exception, match="doc"):
        A.page_lines(pages.drop("doc")).collect()
