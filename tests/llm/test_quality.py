"""The rule ledger against plain loops, policies and ablations."""

import random
import re

from folioscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for at in grams.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(spark, docs_of):
    r = random.Random(2)
    parts = ["word", "é", "#", "$$$", "a", "b", "\n", "\n\n", "\t", "  ", "\r", "ж日", "x y z\n", " ", "\x1c"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "", "\n"]) for _ in range(r.randrange(80))) for _ in range(300)] + [None, "", "\n \n", "a", "a b", "a a a a", "x " * 50_000]
    got = {x.doc_id: x for x in quality.ledger(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(t), repr(t)
        assert bool(x.failed_rules & 1) == (x.n_words < 50) and bool(x.failed_rules & 2) == (100 * x.n_repeat_words > 50 * x.n_words)
        assert x.size == "own"


def test_policies_and_ablations(spark, docs_of):
    good = " ".join(f"word{chr(97 + i % 26)}{i}x" for i in range(120))
    texts = [good, "short", "same words again " * 40, good.replace("x ", "### "), None]
    entries = quality.apply_policy(quality.ledger(docs_of(texts)))
    assert [x.doc_id for x in entries.filter("kept").collect()] == [0]
    abl = {x.rule: (x.fails, x.only_this, x.rejected) for x in quality.ablations(entries).collect()}
    assert abl["few_words"] == (2, 2, 4) and abl["repeated_words"][0] == 1 and abl["many_symbols"] == (1, 1, 4)


def test_keep_good_keeps_columns(spark, docs_of):
    df = docs_of(["short"]).withColumnRenamed("size", "n_words")
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df).isEmpty()
    assert quality.keep_good(docs_of([])).isEmpty() and quality.ledger(docs_of([])).isEmpty()
