"""Water-filled targets and systematic sampling."""

import pytest

from folioscope.llm import mixing


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if 2 * sizes[n] <= level * weight[n]}
        for n in full or open_:
            out[n] = float(2 * sizes[n]) if full else level * weight[n]
            left -= out[n]
        open_ -= full or open_
    return out


def table(spark, sources):
    rows = [(100 * k + i, " w" * n, "en", s, 0, "own") for k, (s, ns) in enumerate(sources) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


CASES = [
    [("a", [10, 20, 30]), ("b", [500, 1, 1]), ("c", [7] * 40), (None, [3, 4]), ("é", [90, 2])],
    [("a", [5] * 30)],
    [("a", [0, 0]), ("b", [1000])],
]


@pytest.mark.parametrize("sources", CASES)
def test_targets_and_words_taken(spark, sources):
    df = table(spark, sources)
    rows = mixing.mix(spark, df).collect()
    want = fill({s: sum(ns) for s, ns in sources})
    biggest = {s: max(ns) for s, ns in sources}
    for s in want:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * biggest[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(spark, df).collect()))
    assert len(rows) == df.count()


def test_mixed_rows_match_the_plan(spark):
    df = table(spark, CASES[0]).unionByName(table(spark, [("a", [10, 20])]))
    taken = sum(r.taken for r in mixing.mix(spark, df).collect())
    out = mixing.mixed(spark, df)
    assert out.columns == df.columns and sum(len(r.text.split()) for r in out.collect()) == taken


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "a"), (2, "x y", "a")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark, df).collect()}
    assert got[None] == (0, 0) and got[1] == (0, 0) and got[2][0] == 2
    assert mixing.mix(spark, df.limit(0)).isEmpty() and mixing.mixed(spark, df.limit(0)).isEmpty()
