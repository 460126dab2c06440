"""Asking, reasoning, synchronising, configuration, storing and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import answer, sync
from folioscope.operators.answer import Corpus, Flags
from folioscope.plans import catalog, providers
from folioscope.plans.config import Settings, last_page
from folioscope.sources import pages as P
from folioscope.sources import snapshots


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["soluble fiber lowers cholesterol", "insoluble fiber helps digestion", "protein builds muscle", "water is life"]
    vec = providers.HashEmbedder(256).embed(texts)
    rows = [(f"g{i}", "o", "en", f"p{i // 2}", "book", 40 + i // 2, t, v) for i, (t, v) in enumerate(zip(texts, vec, strict=True))]
    chunks = spark.createDataFrame(rows, "guid string, owner string, language string, parent string, source_key string, page int, text string, embedding array<double>")
    return Corpus(chunks, spark.createDataFrame([("p0", "page zero on fiber"), ("p1", "page one")], "guid string, text string"))


def offline(**replies):
    return providers.Providers(providers.HashEmbedder(256), providers.OverlapReranker(), providers.RecordedText({k: v if isinstance(v, list) else [v] for k, v in replies.items()}))


def test_ask_modes(spark, corpus):
    p = offline(answer="Short answer: Yes\n\nSoluble fiber lowers cholesterol.", split="SUBQ: what is soluble fiber?\nsubq: what is protein?")
    got = answer.ask(spark, corpus, "Does soluble fiber lower cholesterol?", p, Flags(n=2))
    assert got.short == "Yes" and got.rows[0]["guid"] == "g0" and "fiber" in got.grounding and got.context.startswith("[Excerpt 1 -- book]")
    got = answer.ask(spark, corpus, "fiber and protein?", p, Flags(n=3, multi_query=True, hybrid=True, rerank=True))
    assert got.used["sub_questions"] == ["what is soluble fiber?", "what is protein?"] and len(got.rows) == 3
    got = answer.ask(spark, corpus, "soluble fiber insoluble fiber", p, Flags(n=2, hybrid=True, expand=True))
    assert [r["expanded_from_parent"] for r in got.rows] == [True] * len(got.rows) and 40 in got.pages and got.warnings
    with pytest.raises(ValueError):
        answer.ask(spark, corpus, " ", p)


def test_hyde_only_where_nothing_comes_before_it(spark, corpus):
    p = offline(hyde="protein builds muscle", answer="No idea")
    assert answer.ask(spark, corpus, "what for?", p, Flags(n=1, hyde=True)).rows[0]["guid"] == "g2"
    assert not answer.ask(spark, corpus, "what for?", p, Flags(n=1, hyde=True, hybrid=True)).used["hyde"]


@pytest.mark.parametrize(("replies", "kw", "steps", "verified"), [
    (['{"supported": true}'], {}, 1, True),
    (['{"supported": false, "refine_query": "protein"}', 'so: {"supported": true}'], {}, 2, True),
    (['{"supported": false, "refine_query": "x"}'], {"max_steps": 3}, 3, False),
    (["none"], {"self_check": False}, 1, None),
    (['{"supported": false}'], {}, 1, False),
    (["no verdict"], {}, 1, True),
])
def test_reasoning(spark, corpus, replies, kw, steps, verified):
    got = answer.ask_with_reasoning(spark, corpus, "fiber?", offline(answer="a", check=replies), Flags(n=1), **kw)
    assert (got.steps, got.verified) == (steps, verified)


def test_understanding():
    assert answer.understand("q", lambda q: 'Sure {"language": "fr", "query": "Is cocoa a vegetable?"} ok').language == "FR"
    assert "kyā yoga hai?" in answer.understand("क्या योग है?", lambda q: "I can't").query
    assert answer.split_question("q", "no lines") == ["q"]


def test_sync_converges(spark):
    t = lambda rows: spark.createDataFrame(rows, "guid string, digest string")
    stored, wanted = t([("a", "1"), ("b", "1"), ("c", "1")]), t([("b", "1"), ("c", "2"), ("d", "1")])
    assert {(r.guid, r.action) for r in sync.actions(stored, wanted, "guid", "digest").collect()} == {("a", "delete"), ("c", "update"), ("d", "insert")}
    after = sync.delete(sync.upsert(stored, wanted, "guid"), stored.join(wanted, "guid", "left_anti"), "guid")
    assert sync.actions(after, wanted, "guid", "digest").isEmpty()
    assert [r.guid for r in sync.insert_absent(stored, wanted, "guid").collect()] == ["d"]


def test_cascade_and_status(spark):
    sources = spark.createDataFrame([("s", "yoga_book", "fr", 3), ("t", "yoga_book", "en", 9)], "guid string, source_key string, language string, page_count int")
    pages = spark.createDataFrame([("p1", "s"), ("p2", "t")] + [(f"q{i}", "t") for i in range(9)], "guid string, owner string")
    chunks = spark.createDataFrame([("c1", "t")], "guid string, owner string")
    left = sync.cascade(sources.filter("guid = 's'"), pages, chunks)
    assert [x.count() for x in left] == [10, 1]
    got = sync.book_status(sources, pages, chunks, "%YOGA%").first()
    assert (got.language, got.pages, got.complete, got.ready) == ("en", 10, True, True)
    assert not sync.book_status(sources, pages, chunks, "%yoga%", 11).first().ready


def test_translated_index(spark):
    df = spark.createDataFrame([("k", "ru", 1, [((["a", "b"]), (0.81,)), (["c"], None)])], "source_key string, language string, page int, blocks array<struct<words:array<string>,layout:struct<scale:double>>>")
    assert tuple(sync.translated_index(df).first())[3:] == (2, 3, 0.81)


def test_settings():
    s = Settings({"N": " 5 ", "B": "Yes", "BAD": "maybe", "ALL": "NONE", "ZERO": "-3"})
    assert (s.number("N", 1), s.number("X", 7), s.flag("B", False), s.limit("ALL", 9), s.limit("X", 9), s.limit("N", None)) == (5, 7, True, None, 9, 5)
    for call in (lambda: s.flag("BAD", True), lambda: s.number("BAD", 1), lambda: s.limit("ZERO", 1), lambda: s.text("X")):
        with pytest.raises(ValueError):
            call()
    assert (last_page(303, None, 3), last_page(1, None, None), last_page(1, 9, 3)) == (305, None, 9)


def test_catalog(spark):
    assert [f(spark).count() for f in (catalog.languages, catalog.definitions, catalog.attributes, catalog.relations)] == [3, 16, 13, 3]
    assert {r.code: r.parent_label for r in catalog.definitions(spark).collect()}["person"] == "Agent"


def test_providers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert providers.with_retry(flaky, sleep=lambda s: None) == "done" and len(calls) == 3
    with pytest.raises(OSError):
        providers.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=lambda s: None)
    with pytest.raises(ValueError):
        providers.providers("nobody")


def test_embedding_and_translation(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", None)], "id string, text string")
    assert [len(r.embedding) for r in providers.embed_column(df, providers.HashEmbedder(8)).collect()] == [8, 8]
    cache = spark.createDataFrame([("1", "kept")], "id string, translated string")
    got = {r.id: r.translated for r in providers.translate_missing(df.fillna(""), cache, lambda ts: [t.upper() for t in ts]).collect()}
    assert got == {"1": "kept", "2": None}


def page(n, text):
    return {"schema_version": 1, "page": n, "lang": "fr", "blocks": [{"id": f"b{i}", "type": "paragraph", "reading_order": i, "text": t, "words": []} for i, t in enumerate(text)]}


def test_page_json_to_rows_and_stream(spark, tmp_path):
    for n, text in ((1, ["un deux", "", "trois"]), (2, ["quatre"])):
        f = tmp_path / "out" / "fr" / "livre" / "json" / f"page_{n:04d}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(page(n, text), indent=1))
    docs = P.read_page_json(spark, str(tmp_path / "out"))
    rows = {r.page_number: r for r in P.page_rows(docs).collect()}
    assert rows[1].text == "un deux\ntrois" and rows[1].language == "fr" and rows[1].source_key == "livre"
    assert P.source_rows(docs).first().recognised_pages == 2
    path = P.swap_snapshot(spark, P.page_rows(docs), str(tmp_path / "snap"))
    assert os.path.isdir(path) and P.current_snapshot(spark, str(tmp_path / "snap")).count() == 2

    from folioscope.streaming.ingest import ingest

    P.write_page_json(docs, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "chunks"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert snapshots.current(spark, str(tmp_path / "chunks")).count() == 2
    # a page that comes again in a later epoch takes its chunks' place
    P.write_page_json(docs.filter("page = 1").withColumn("blocks", F.transform("blocks", lambda b: b.withField("text", F.lit("neuf")))), str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "chunks"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.text for r in snapshots.current(spark, str(tmp_path / "chunks")).collect()) == ["neuf\nneuf\nneuf", "quatre"]
    assert sorted((r.language, r.source_key, r.page, len(r.blocks)) for r in P.read_page_json(spark, str(tmp_path / "in")).collect()) == [("fr", "livre", 1, 3), ("fr", "livre", 2, 1)]


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\0")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = P.scan_files(spark, str(tmp_path))
    none = spark.createDataFrame([], "path string, length long, reading string")
    got = P.cached_readings(files, none, lambda b: b.decode()).collect()
    assert [(r.length, r.reading) for r in got] == [(4, "one")]
    assert P.scan_files(spark, str(tmp_path), known=files).isEmpty()
    assert [r.page for r in P.pages_to_do(spark, 1, 3, spark.createDataFrame([(2,)], "page int")).orderBy("page").collect()] == [1, 3]


def test_integrity(spark):
    s = spark.createDataFrame([("s", "x", "k", "fr")], "guid string, owner string, source_key string, language string")
    p = spark.createDataFrame([("p", "s", 1), ("q", "none", 1)], "guid string, owner string, page int")
    c = spark.createDataFrame([("c", "p", 0), ("d", "p", 0)], "guid string, parent string, ord int")
    assert sorted((r.fault, r.guid) for r in catalog.integrity_faults(s, p, c).collect()) == [("chunk order twice", "c"), ("chunk order twice", "d"), ("page without a source", "q"), ("source doesn't own itself", "s")]
    assert F is not None
