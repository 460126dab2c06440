"""Repeated passages against brute force over all windows."""

import random

import pytest

from folioscope.llm import suffixes


def brute(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            if key in seen:
                out.setdefault(i, set()).update(range(j, j + length))
            seen.add(key)
    return out


@pytest.mark.parametrize("length", [12, 50])
def test_against_brute_force(spark, docs_of, length):
    r = random.Random(length)
    words = [f"w{i}" for i in range(60)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passages = [make(r.randrange(length, 2 * length)) for _ in range(8)] + [["a", "b"] * length]
    texts = []
    for _ in range(120):
        t = make(r.randrange(0, 80))
        for p in r.sample(passages, r.randrange(3)):
            cut = r.randrange(len(p) - length + 2)
            t += p[cut:] + make(r.randrange(5))
        texts.append(" ".join(t))
    texts += [None, "", texts[3], texts[3], "z " * 3 * length]
    got = {}
    for x in suffixes.repeats(spark, docs_of(texts), length).collect():
        assert x.source_id <= x.doc_id
        got.setdefault(x.doc_id, set()).update(range(x.start, x.start + x.n_words))
    assert got == brute(dict(enumerate(texts)), length)


def test_without_repeats(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(55))
    df = docs_of([f"start {passage} end", f"other\n{passage}\n\nrest", passage, "clean  text ", None])
    out = {x.doc_id: x for x in suffixes.without_repeats(spark, df).collect()}
    assert {i: x.text for i, x in out.items()} == {0: f"start {passage} end", 1: "other\nrest", 3: "clean  text ", 4: None}
    assert out[1].n_chars == len("other\nrest") and suffixes.without_repeats(spark, df).columns == df.columns


def test_edges(spark, docs_of):
    assert suffixes.repeats(spark, docs_of([])).isEmpty()
    text = " ".join(f"p{i}" for i in range(60))
    twice = docs_of([text]).unionByName(docs_of([text]))
    assert suffixes.repeats(spark, twice).isEmpty()  # one id, one text
    nulls = docs_of([text, text]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "size")
    assert suffixes.repeats(spark, nulls).isEmpty() and suffixes.without_repeats(spark, nulls).count() == 2


def test_cut_words():
    assert suffixes.cut_words(" a b  c\nd ", [(1, 2)]) == " a d " and suffixes.cut_words("a b", [(0, 9)]) == "" and suffixes.cut_words("a b", []) == "a b"
