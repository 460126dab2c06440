"""Jobs from page documents to answers, recognition behind providers, one book's questions, and how answers are shown."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from folioscope import jobs
from folioscope.functions import display
from folioscope.operators import answer, book, chunking
from folioscope.plans import prompts
from folioscope.plans import providers as P
from folioscope.sources import pages as S
from folioscope.sources import snapshots as N

PAGES = {1: "Protein builds muscle.", 2: "Fat stores energy.", 3: "Water is essential."}


def write_documents(folder, pages):
    d = folder / "en" / "food" / "json"
    d.mkdir(parents=True, exist_ok=True)
    for f in d.glob("*.json"):
        f.unlink()
    for n, text in pages.items():
        (d / f"page_{n:04d}.json").write_text(json.dumps({"page": n, "blocks": [{"id": f"b{n}", "reading_order": 1, "text": text}]}))


def test_from_documents_to_answers(spark, tmp_path):
    docs, p, c, s = (str(tmp_path / x) for x in ("docs", "pages", "chunks", "sources"))
    write_documents(tmp_path / "docs", PAGES)
    assert jobs.upload(spark, docs, p, s, c) == {"insert": 3} and jobs.upload(spark, docs, p, s, c) == {}
    assert jobs.build_chunks(spark, p, c) == {"chunks": 3, "removed": 0}
    before = {t: N.numbers(spark, t) for t in (p, c, s)}
    assert jobs.upload(spark, docs, p, s, c) == {} and jobs.build_chunks(spark, p, c) == {"chunks": 0, "removed": 0}
    assert before == {t: N.numbers(spark, t) for t in (p, c, s)}  # nothing was written
    write_documents(tmp_path / "docs", {1: PAGES[1], 3: "Water is life."})
    assert jobs.upload(spark, docs, p, s, c) == {"delete": 1, "update": 1, "blocks": 1, "chunks": 1} and N.current(spark, s).first().recognised_pages == 2
    assert {r.page_number for r in N.current(spark, c).collect()} == {1, 3}  # chunks of the page that went are gone
    assert jobs.build_chunks(spark, p, c) == {"chunks": 1, "removed": 0}
    assert {r.text for r in N.current(spark, c).collect()} == {PAGES[1], "Water is life."}
    got = jobs.ask(spark, p, c, "protein and muscle?", hybrid=True, n=1)
    assert got["source_pages"] == [1] and got["chunks_used"] == 1 and got["candidates_considered"] == 1 and len(got) == 17


def test_sources_that_went_and_sources_that_stay(spark, tmp_path):
    docs, p, c, s = (str(tmp_path / x) for x in ("docs", "pages", "chunks", "sources"))
    write_documents(tmp_path / "docs", PAGES)
    other = tmp_path / "docs" / "fr" / "pain" / "json"
    other.mkdir(parents=True)
    (other / "page_0001.json").write_text(json.dumps({"page": 1, "blocks": [{"id": "b", "reading_order": 1, "text": "Le pain"}]}))
    assert jobs.upload(spark, docs, p, s) == {"insert": 4}
    jobs.build_chunks(spark, p, c)
    read = []
    whole = S.read_page_json
    S.read_page_json = lambda spark, folder, only=None: read.append(only) or whole(spark, folder, only)
    try:
        (other / "page_0001.json").write_text(json.dumps({"page": 1, "blocks": [{"id": "b", "reading_order": 1, "text": "Le pain frais"}]}))
        assert jobs.upload(spark, docs, p, s, c) == {"update": 1, "blocks": 1} and read == [[("fr", "pain")]]  # the other source isn't read
        shutil.rmtree(tmp_path / "docs" / "en")
        assert jobs.upload(spark, docs, p, s, c) == {"delete": 3, "chunks": 3} and read[1] == []
    finally:
        S.read_page_json = whole
    assert [r.text for r in N.current(spark, p).collect()] == ["Le pain frais"] and [r.source_key for r in N.current(spark, s).collect()] == ["pain"]
    assert jobs.build_chunks(spark, p, c) == {"chunks": 1, "removed": 0} and [r.text for r in N.current(spark, c).collect()] == ["Le pain frais"]
    shutil.rmtree(tmp_path / "docs")
    assert jobs.upload(spark, docs, p, s, c) == {"delete": 1, "chunks": 1} and N.current(spark, s).isEmpty()


def test_buckets_that_arent_touched_are_shared(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(LookupError):
        N.current(spark, folder)
    rows = spark.range(100).selectExpr("id AS guid", "'a' AS v")
    assert N.merge(spark, folder, rows, buckets=16) == 1
    one = spark.createDataFrame([(7, "b"), (7, "c")], "guid long, v string")
    assert N.merge(spark, folder, one) == 2 and N.merge(spark, folder, rows.limit(0)) is None
    first, second = (N.manifest(spark, folder, n)["buckets"] for n in (1, 2))
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 16
    old, now = N.current(spark, folder, 1), N.current(spark, folder)
    assert now.count() == 100 and now.filter("v <> 'a'").collect() == [(7, "c")] and old.filter("v <> 'a'").isEmpty()
    assert N.merge(spark, folder, gone=spark.range(90).withColumnRenamed("id", "guid")) == 3 and N.current(spark, folder).count() == 10
    assert N.expire(spark, folder, keep=1) > 0 and N.numbers(spark, folder) == [3] and N.current(spark, folder).count() == 10
    with pytest.raises(N.Conflict):
        N._commit(spark, folder, 3, {})
    assert N.merge(spark, folder, gone=N.current(spark, folder)) == 4 and N.current(spark, folder).isEmpty()
    assert N.merge(spark, folder, spark.createDataFrame([(None, "n"), (1, "x")], "guid long, v string")) == 5
    assert N.merge(spark, folder, spark.createDataFrame([(None, "m")], "guid long, v string")) == 6 and sorted(r.v for r in N.current(spark, folder).collect()) == ["m", "x"]


def test_snapshots_are_never_rewritten(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(LookupError):
        S.current_snapshot(spark, folder)
    S.swap_snapshot(spark, spark.range(2), folder)
    first = S.current_snapshot(spark, folder)
    S.swap_snapshot(spark, spark.range(3), folder)
    assert first.count() == 2 and S.current_snapshot(spark, folder).count() == 3


def test_recognition(spark, tmp_path):
    images = spark.createDataFrame([("k", "fr", n, b"image") for n in (1, 2, 3)], "source_key string, language string, page int, content binary")
    block = {"block_id": "x", "type": "heading", "box": [0, 0, 500, 1000], "words": [{"t": "Chapitre", "box": [0, 0, 10, 10]}]}
    reader = P.JsonRecogniser(lambda image, prompt, schema: "```json\n" + json.dumps({"blocks": [block]}) + "\n```")
    folder = str(tmp_path / "docs")
    assert jobs.recognise(spark, images, reader, folder, 2) == {"recognised": 2, "failed": 0}
    read = lambda: sorted((r.page, r.blocks[0].text, r.blocks[0].id) for r in S.read_page_json(spark, folder).collect())
    assert read() == [(2, "Chapitre", "p0002_b001"), (3, "Chapitre", "p0003_b001")]

    def other(image, prompt, schema):
        if image == b"bad":
            raise OSError("no picture")
        (tmp_path / "asked").mkdir(exist_ok=True)
        (tmp_path / "asked" / str(len(list((tmp_path / "asked").iterdir())))).write_text("")
        return json.dumps({"blocks": [block | {"words": [{"t": "Autre", "box": [0, 0, 10, 10]}]}]})

    assert jobs.recognise(spark, images, P.JsonRecogniser(other), folder, 2) == {"recognised": 0, "failed": 0} and not (tmp_path / "asked").exists()  # nothing is asked twice
    assert jobs.recognise(spark, images, P.JsonRecogniser(other), folder, 3, force=True) == {"recognised": 1, "failed": 0}
    assert [t for _, t, _ in read()] == ["Chapitre", "Autre"]  # force replaces
    worse = images.withColumn("content", F.when(F.col("page") == 1, F.lit(b"bad")).otherwise(F.col("content")))
    assert jobs.recognise(spark, worse, P.JsonRecogniser(other), folder, attempts=1) == {"recognised": 0, "failed": 1} and len(read()) == 2
    assert jobs.upload(spark, folder, str(tmp_path / "p"), str(tmp_path / "s")) == {"insert": 2} and jobs.upload(spark, folder, str(tmp_path / "p"), str(tmp_path / "s")) == {}
    tool = P.ToolRecogniser(lambda image, prompt, t: [{"type": "text"}, {"type": "tool_use", "name": t["name"], "input": {"blocks": [block]}}])
    assert P.recognise_pages(images, tool).count() == 3
    empty = P.JsonRecogniser(lambda image, prompt, schema: '{"blocks": []}')
    with pytest.raises(Exception, match="without blocks"):
        P.recognise_pages(images, empty, attempts=2, sleep=lambda s: None).collect()
    with pytest.raises(ValueError):
        P.tool_reply([{"type": "text"}], "page")


def test_page_texts(spark):
    files = spark.createDataFrame([("a.pdf", b"one\x0ctwo\x00"), ("b.pdf", b"")], "path string, content binary")
    assert sorted(map(tuple, P.read_pages(files, P.LineOcr()).collect())) == [("a.pdf", 0, "one"), ("a.pdf", 1, "two"), ("b.pdf", 0, "")]


def test_translations_by_id(spark, tmp_path):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    cache = spark.createDataFrame([(1, "A"), (1, "AA"), (2, " ")], "id long, translated string")

    def call(texts):
        return {k: t.upper() for k, t in texts.items() if t != "c"} | {99: "X"}

    call.by_id = True
    assert sorted((r.id, r.translated) for r in P.translate_missing(units, cache, call).collect()) == [(1, "AA"), (2, "B"), (3, None)]
    strings = units.withColumn("id", F.col("id").cast("string"))
    for _ in range(2):
        got = jobs.translate(spark, strings, str(tmp_path / "cache"), call)
    assert sorted((r.id, r.translated) for r in got.collect()) == [("1", "A"), ("2", "B"), ("3", None)]


def test_chunks_by_counted_tokens(spark):
    df = spark.createDataFrame([(1, "a b", ["a", "b"]), (2, "a b c d", ["a b", "", "c", "d"]), (3, "a b c", None)], "guid int, text string, blocks array<string>")
    count = lambda texts: F.transform(texts, lambda t: F.size(F.split(t, " ")))
    assert {r.guid: r.chunks for r in chunking.counted_chunks(df, 2, count).collect()} == {1: ["a b"], 2: ["a b", "c\nd"], 3: ["a b c"]}


def corpus(spark):
    e = P.HashEmbedder()
    rows = [(f"g{n}", "book", "en", f"p{n}", "food", n, t, e.embed([t])[0]) for n, t in PAGES.items()] + [("h", "other", "en", "q", "other", 9, "Protein builds muscle too.", e.embed(["x"])[0])]
    chunks = spark.createDataFrame(rows, "guid string, owner string, language string, parent string, source_key string, page int, text string, embedding array<double>")
    return answer.Corpus(chunks, chunks.select(F.col("parent").alias("guid"), "text"))


def test_questions_to_one_book(spark):
    c = corpus(spark)
    sources = spark.createDataFrame([("book", "food", "en", 3)], "guid string, source_key string, language string, page_count int")
    pages = c.chunks.select("owner")
    status = book.find_book(sources, pages, pages, "%FOO%")
    assert status["ready"] and "3 of 3" in book.readiness(status)
    with pytest.raises(LookupError):
        book.find_book(sources, pages, pages, "%nothing%")
    text = P.RecordedText({"understand": ['{"language": "en", "query": "protein muscle"}'], "split": ["SUBQ: protein\nSUBQ: energy"], "answer": ["Short answer: No\n\n**Protein** builds muscle"]})
    qa = book.BookQA(spark, c, status, P.Providers(text=text), language="FR", n=2)
    (got,), page = qa.ask_all(["What builds muscle & stores energy?"])
    assert got.short == "No" and {r["owner"] for r in got.rows} == {"book"} and got.result()["subquestions"] == ["protein", "energy"] and len(got.result()) == 19
    assert "<b>Protein</b>" in page and "muscle &amp; stores" in page and any("French" in p for t, p in text.prompts if t == "answer")
    assert {r.form for r in qa.compare_retrieval("energy?", 2).collect()} == {"raw", "prepared"}
    assert "built-in" in book.prompt_message(prompts.ANSWER) and "no Short answer" in book.prompt_message("x")


def test_display(spark):
    assert display.markdown("# A\ntext *it* `a<b`\nmore\n\n- x\n- **y**\nend") == "<h4>A</h4><p>text <i>it</i> <code>a&lt;b</code><br>more</p><ul><li>x</li><li><b>y</b></li></ul><p>end</p>"
    assert display.format_pages([3, 4, 5, 13, 14, 20]) == "3-5, 13-14, 20" and display.format_pages([]) == "-" and display.labels("ru")["Yes"] == "Да"
    df = spark.createDataFrame([("a **b**",), (None,)], "t string")
    assert [r.h for r in df.select(display.markdown_column(F.col("t")).alias("h")).collect()] == ["<p>a <b>b</b></p>", None]
    assert answer.language_name("uk") == "Ukrainian" and answer.language_name("xx") == "xx" and "Ukrainian" in answer.language_directive("UK")


def test_commands(spark, tmp_path, capsys):
    images = tmp_path / "images" / "fr" / "livre"
    images.mkdir(parents=True)
    (images / "page_0001.txt").write_text("Le pain nourrit\nle corps\n")
    (images / "page_0002.txt").write_text("L'eau est bonne")
    at = {x: str(tmp_path / x) for x in ("images", "folder", "pages", "sources", "chunks")}
    every = [f"--{k}={v}" for k, v in at.items()]

    def run(*args):
        jobs.main(list(args))
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    whole = ["run-all", *every, "--source-language=fr", "--languages", "en", "de"]
    assert run(*whole) == {"recognise": {"recognised": 2, "failed": 0}, "translate": {"en": {"translated": 2, "failed": 0}, "de": {"translated": 2, "failed": 0}}, "upload": {"insert": 6}, "chunks": {"chunks": 6, "removed": 0}}
    assert run(*whole) == {"recognise": {"recognised": 0, "failed": 0}, "translate": {"en": {"translated": 0, "failed": 0}, "de": {"translated": 0, "failed": 0}}, "upload": {}, "chunks": {"chunks": 0, "removed": 0}}
    assert run("recognise", every[0], every[1], "--start=2", "--force") == {"recognised": 1, "failed": 0}
    assert run("translate", every[1], "--source-language=fr", "--languages", "en", "--force", "--end=1") == {"en": {"translated": 1, "failed": 0}}
    assert run("upload", *every[1:]) == {} and run("chunks", every[2], every[4]) == {"chunks": 0, "removed": 0}
    assert run("ask", every[2], every[4], "--hybrid", "--n=2", "Le pain?")["chunks_used"] == 2
    with pytest.raises(ValueError, match="unknown provider"):
        jobs.main(["recognise", every[0], every[1], "--recogniser=none"])
