"""Near duplicates against brute force on full sets."""

import random

import pytest

from folioscope.llm import components, neardup


def sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(texts, k, percent=80):
    s = sets(texts, k)
    comp = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]) and comp[a] != comp[b]:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return s, comp


def near(r, base, edits):
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, docs_of, k):
    r = random.Random(k)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(r.choices(words, k=r.randrange(20, 200))) for _ in range(40)]
    texts = base + [near(r, b, e) for b in base[:25] for e in (0, 1, 2, 4, 7)] + [near(r, base[0], 1) for _ in range(70)]
    texts += [None, "", "  \n", "one two", "ONE two", "a b c", base[1].upper(), "ü é", "Ü é", base[2] + " " + "\t"]
    got = {x.doc_id: x for x in neardup.near_duplicates(spark, docs_of(texts), neardup.Join(k=k, leaf=16, depth=3)).collect()}
    s, comp = brute(dict(enumerate(texts)), k)
    assert {i: (len(s[i]), comp[i], comp[i] == i) for i in comp} == {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()}


def test_edges(spark, docs_of):
    assert neardup.near_duplicates(spark, docs_of([])).count() == 0
    long = " ".join(map(str, range(60_000)))
    rows = docs_of([long, long + " x", "only one"]).unionByName(docs_of(["only one"], start=2))
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark, rows).collect())
    assert [(x[0], x[2]) for x in got] == [(0, 0), (1, 0), (2, 2), (2, 2)]
    nulls = docs_of(["a b", "a b"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "size")
    assert [(x.component_id, x.kept) for x in neardup.near_duplicates(spark, nulls).collect()] == [(None, True)] * 2


def test_deduplicated_keeps_columns_and_one_of_each_group(spark, docs_of):
    df = docs_of(["a b c d e f g", "x y", "a b c d e f g", None, "A b c d e f g"])
    out = neardup.deduplicated(spark, df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [0, 1, 3]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)]
    got = {x.id: x.component for x in components.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 50, 70: 50, 50: 50}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize(("n", "changed", "least"), [(600, 8, 0.995), (2400, 8, 0.995), (2400, 18, 0.98)])
def test_single_partners_in_large_clusters(spark, n, changed, least):
    """Each text has one partner; all others share three quarters with it, which is no link."""
    core, rows = [f"c{i}" for i in range(258)], []
    for p in range(n // 2):
        own = [f"p{p}x{j}" for j in range(40)]
        for k in (0, 1):
            rows.append((2 * p + k, " ".join(core + [f"p{p}k{k}y{j}" if abs(j - 19.5) < changed / 2 else w for j, w in enumerate(own)])))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), neardup.Join(k=4)).groupBy("component_id").agg({"doc_id": "collect_list"}).collect()
    found = [sorted(r[1]) for r in got if len(r[1]) > 1]
    assert all(len(x) == 2 and x[0] % 2 == 0 and x[1] == x[0] + 1 for x in found)  # no false links
    assert len(found) >= least * (n // 2)


@pytest.mark.parametrize("how", [neardup.Join(k=4, trees=1, leaf=4, depth=0), neardup.Join(k=4, trees=1, leaf=400, depth=2), neardup.Join(k=4)])
def test_no_link_is_lost_whatever_the_forest_is(spark, docs_of, how):
    """Single partners at 0.87 and chains in one cluster of texts at 0.76, copies, and texts of one shingle."""
    r = random.Random(7)
    core, texts = [f"c{i}" for i in range(258)], []
    for p in range(60):
        own = [f"p{p}x{j}" for j in range(40)]
        texts += [" ".join(core + [f"p{p}k{k}y{j}" if abs(j - 19.5) < 4 else w for j, w in enumerate(own)]) for k in (0, 1)]
    for p in range(6):
        texts.append(near(r, texts[p], 3))
        texts += [near(r, texts[-1], 7) for _ in range(4)] + [texts[-1]]
    texts += ["one two", "one two", "one", None]
    got = {x.doc_id: x for x in neardup.near_duplicates(spark, docs_of(texts), how).collect()}
    s, comp = brute(dict(enumerate(texts)), 4)
    assert {i: (len(s[i]), comp[i], comp[i] == i) for i in comp} == {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()}


def test_large_postings_in_several_blocks(spark):
    """Long texts of one cluster that fill more than a block: links across blocks are found, and none else."""
    core, rows = [f"c{i}" for i in range(9000)], []
    for p in range(40):
        own = [f"p{p}x{j}" for j in range(1400)]
        for k in (0, 1):
            rows.append((2 * p + k, " ".join(core + [f"p{p}k{k}y{j}" if j < 300 else w for j, w in enumerate(own)])))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), neardup.Join(k=4, trees=1, leaf=4, depth=0, slack=-1.0)).collect()
    assert {x.doc_id: x.component_id for x in got} == brute(dict(rows), 4)[1]


def test_bitmaps_never_rule_out_a_link():
    r = neardup.np.random.default_rng(3)
    a = neardup.np.unique(r.integers(0, 1 << 63, 3000, dtype=neardup.np.uint64))
    for n in (1, 5, 50, 900, 3000):
        x = a[:n]
        y = neardup.np.sort(neardup.np.concatenate((x[n // 10 :], r.integers(0, 1 << 63, n // 10, dtype=neardup.np.uint64))))
        both = neardup.bitmaps(neardup.np.concatenate((x, y)), neardup.np.array([0, n, n + len(y)]))
        linked = 100 * len(neardup.np.intersect1d(x, y)) >= 80 * len(neardup.np.union1d(x, y))
        assert linked and neardup._may_link(neardup.np.array([n]), both[:1], neardup.np.array([len(y)]), both[1:], 80)[0]
