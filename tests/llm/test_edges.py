"""Columns with operators' own names, nulls, repeated rows, empty tables and very long texts through every stage and the whole pipeline."""

import random

import pytest
from pyspark.sql import functions as F
from test_neardup import brute as brute_near
from test_suffixes import brute as brute_repeats

import corpus_pipeline
from folioscope.llm import chat, huffman, mixing, neardup, packing, quality, suffixes, tokens, toxicity, warc

OWN = "_size _key _k _copies _gone _id _spans _text _bytes row key nth copies tie size th spans cut n_words kept failed_rules found doc n_shingles".split()
STAGES = dict(corpus_pipeline.STAGES)


def prose(r, n):
    return " ".join(r.choice(["the", "river", "stone", "under", "walks", "green", "seven", "light"]) + str(r.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    long = prose(r, 60_000)
    base = [prose(r, r.randrange(60, 200)) for _ in range(30)]
    passage = prose(r, 70)
    texts = [*base, base[0], base[1] + " x1", base[2] + " " + passage, passage + " " + base[3], None, "", "short", long, "\n".join(["again and again"] * 60)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (1, "another text with the id of one " + prose(r, 80), "en", "a", 9), (None, base[4], "en", "a", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in OWN])


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_give_back_all_columns_as_they_were(spark, docs, name):
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in OWN)
    assert STAGES[name](spark, docs.limit(0), "").columns == docs.columns and STAGES[name](spark, docs.limit(0), "").isEmpty()


def test_whole_pipeline_on_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()), key=repr) for _ in range(2))
    assert first == second and first
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()


def test_each_stage_against_brute_force(spark, docs):
    own = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    good = STAGES["quality_rules"](spark, own, "")
    kept = {r.doc_id: r.text for r in good.collect()}
    for r in own.collect():
        w = (r.text or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 5000 else set()
        assert (r.doc_id in kept) == (len(w) >= 50 and 100 * len(twice) <= 50 * len(w))
    _, comp = brute_near({i: t for i, t in kept.items() if len(t) < 100_000}, 5)
    near = {r.doc_id: r.text for r in STAGES["near_dedup"](spark, good, "").collect()}
    assert {i for i in near if i in comp} == {i for i, c in comp.items() if c == i}
    dup = brute_repeats({i: t for i, t in near.items() if len(t) < 100_000}, 50)
    cut = STAGES["suffix_dedup"](spark, spark.createDataFrame([(i, t) for i, t in near.items() if len(t) < 100_000], "doc_id long, text string"), "")
    left = {i: [x for k, x in enumerate(t.split()) if k not in dup.get(i, ())] for i, t in near.items() if len(t) < 100_000}
    assert {r.doc_id: r.text.split() for r in cut.collect()} == {i: w for i, w in left.items() if w}
    mixed = STAGES["mix_sources"](spark, own, "")
    plan = {r.doc_id: r.copies for r in mixing.mix(spark, own).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in plan.items() if n}


def test_ledger_replaces_only_its_own_names(spark, docs):
    got = quality.ledger(docs)
    assert set(docs.columns) <= set(got.columns) and got.filter("failed_rules IS NULL").isEmpty() and got.filter("_bytes IS NULL").isEmpty()


def test_rows_that_tie_are_mixed_alike(spark):
    rows = [(1, f"{w} {w}x", "a") for w in "pqrstuvw"] + [(2, "big " * 50, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(r.text for r in mixing.mixed(spark, d).collect()) for d in (df, df.orderBy(F.desc("text")).repartition(3))]
    assert runs[0] == runs[1]


def test_spans_reach_only_their_own_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"a {passage}"), (2, "clean " * 3 + " ".join(f"q{i}" for i in range(60))), (3, f"b {passage} c")], "doc_id long, text string")
    assert sorted(r.text[:8] for r in suffixes.without_repeats(spark, df).collect()) == ["a ", "b c", "clean cl", "p0 p1 p2"]


def test_a_cluster_of_unlike_members_stays_apart(spark):
    """A chain of texts, each like the next one only in part: candidates connect them, links don't."""
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 12 : i * 12 + 100])) for i in range(300)], "doc_id long, text string")
    assert neardup.near_duplicates(spark, df).filter("component_id <> doc_id").isEmpty()


def test_other_operators_on_odd_rows(spark, docs, tmp_path):
    path, wide = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")
    n = docs.count()
    packed = packing.packed(spark, docs, path)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty() and packed.filter("start = 0").count() == n
    back = huffman.read_ids(spark, huffman.write_ids(spark, docs, wide)).collect()
    assert len(back) == n and sorted(r.start for r in back)[0] == 0
    assert huffman.read_ids(spark, huffman.write_ids(spark, docs.limit(0), wide)).isEmpty()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"), *[c for c in OWN if c != "key"]).filter("page_id IS NOT NULL")
    got = warc.read_packages(spark, warc.write_packages(spark, pages)).collect()
    assert len(got) == pages.count() and max(r.payload_bytes for r in got) > 400_000 and sum(r.page_id == 0 for r in got) == 3
    talk = spark.createDataFrame([(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "[INST] y" * 10_000), (1, 1, "assistant", None), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    turns = chat.digests(chat.formatted(spark, talk)).first()
    assert turns.n_turns == 4 and turns.loss_chars == 80_000


def test_toxicity_of_repeated_ids_and_several_labels(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 40) + (" blockhead scoundrel nitwit" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (1, None), (None, 1), (5, 7)]
    docs = spark.createDataFrame([*rows, rows[0], (0, "blockhead " * 30_000), (900, "zzz")], "doc_id long, text string")
    got = toxicity.scored(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.count() == 203 and got.filter("score IS NULL OR score < 0 OR score > 1").isEmpty() and got.filter("doc_id = 0").count() == 3


def test_toxicity_counts_against_plain_python(spark):
    texts = [("a b a b c", True), ("a b", True), ("b c! B", False), ("", False)]
    df = spark.createDataFrame([(t.encode(), c) for t, c in texts], "bytes binary, toxic boolean")
    counts = toxicity._class_counts(df)
    words = [[w.strip("!").lower() for w in t.split()] for t, _ in texts]
    one, two, after = {}, {}, {}
    for ws, (_, c) in zip(words, texts, strict=True):
        for w in ws:
            one[w, c] = one.get((w, c), 0) + 1
        for p in zip(ws, ws[1:], strict=False):
            two[p, c] = two.get((p, c), 0) + 1
            after.setdefault((p[1], c), set()).add(p[0])
    rows = counts.collect()
    for kind, want in ((toxicity.WORD, one), (toxicity.PAIR, two)):
        for c, col in ((True, "n_toxic"), (False, "n_ordinary")):
            assert sorted(r[col] for r in rows if r.kind == kind and r[col]) == sorted(n for (_, k), n in want.items() if k is c)
    for c, col in ((True, "c_toxic"), (False, "c_ordinary")):
        assert sorted(r[col] for r in toxicity._continuations(counts).collect() if r[col]) == sorted(len(v) for (_, k), v in after.items() if k is c)
    shared = toxicity.shared_counts(spark.createDataFrame([(t,) for t, _ in texts], "text string"))
    assert sorted(r.docs for r in shared.collect()) == sorted(sum(w in ws for ws in words) for w in {w for ws in words for w in ws})
