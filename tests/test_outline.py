"""Sections from printed matter and rich outlines, rules by source, lookups and payloads."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import lookups, outline, structure, sync
from folioscope.operators.outline import Registry, Rule


def pages(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, page int, text string")


def entries(spark, *rows):
    return spark.createDataFrame([(1, i, level, title, start) for i, (level, title, start) in enumerate(rows)], "doc int, idx int, level int, title string, start int")


def spans(df):
    return sorted((r.start_page, r.end_page, r.title) for r in df.collect())


def test_printed_contents(spark):
    toc = "Contents\nPreface\n1\n1 Energy\n3\n1.1 Units\n3\n2 Fat\n5"
    got = outline.contents_sections(pages(spark, "cover", toc, "preface", "x", "energy", "more", "fat", "end"))
    assert [(r.title, r.level, r.start_page, r.end_page) for r in got.orderBy("start_page").collect()] == [("Preface", 1, 2, 3), ("1.1 Units", 2, 4, 5), ("2 Fat", 1, 6, 7)]
    assert outline.contents_sections(pages(spark, "no list", "x\n1\ny\n2")).isEmpty()


def test_chapters_end_before_what_stands_behind(spark):
    p = pages(spark, "Chapter 1 : One", "Chapter 1 Summary", "x", "Chapter 2 Summary", "Chapter 1 Summary again", "Quiz", "answers")
    titles = spark.createDataFrame([(1, 1, "One")], "doc int, number int, title string")
    got = outline.chapter_sections(p, "Chapter (\\d+) Summary", {"quiz": "^Quiz"}, titles)
    assert spans(got) == [(1, 2, "One"), (3, 4, "Chapter 2"), (5, 6, "quiz")]


def test_rich_outline(spark):
    e = entries(spark, (1, "Preface", 0), (1, "Part", 1), (2, "1: Food", 1), (2, "Chapter 1 Review", 3), (1, "Review Answers", 4), (2, "Chapter 1 Review", 4), (1, "Appendices", 6), (1, "Index", 9))
    p = pages(spark, *["t"] * 7, "Appendix A Weights.\nx", "Appendix B Norms.", "index")
    got = outline.rich_outline(e, p, {1: "Preface", 2: "\\d+:\\s.*|Chapter\\s+\\d+\\s+\\S.*"}, "Review Answers", "Appendices", "(?m)^Appendix\\s+([A-P])\\s+(.+?)\\.\\s*$")
    assert spans(got) == [(0, 0, "Preface"), (1, 2, "1: Food"), (3, 3, "Chapter 1 Review"), (4, 5, "Review Answers"), (7, 7, "Appendix A: Weights"), (8, 8, "Appendix B: Norms")]


def test_level_ends_of_long_outlines(spark):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("doc"), F.floor(F.col("id") / 2).cast("int").alias("idx"))
    e = rows.select("*", (F.col("idx") % 4 + 1).cast("int").alias("level"), F.col("idx").alias("start"))
    got = structure.level_ends(e, F.lit(20_000)).filter("doc = 0 AND idx < 8").orderBy("idx").collect()
    assert [r.end_page for r in got] == [3, 3, 3, 3, 7, 7, 7, 7]


def test_rules_by_source(spark):
    rules = {"book": Rule("Book.pdf", "outline", "native_outline", options={"drop": ("Index",)}, callouts={"tip": "(?i)tip"}), "gone": Rule("é.pdf", "skip", reason="a duplicate"), "none": Rule("None.pdf", "outline", options={"keep": ((None, "Nothing"),)}), "own": Rule("Own.pdf", "custom")}
    own = lambda e, p: spark.createDataFrame([(1, "All", 1, 0, 2)], "doc int, title string, level int, start_page int, end_page int")
    r = Registry(rules, {"own": own})
    e, p = entries(spark, (1, "One", 0), (1, "Index", 2)), pages(spark, "a tip", "b", "c")
    got, kind, unknown = r.sections("Book.pdf", e, p)
    assert [(x.title, x.start_page, x.end_page, x.text, x.tags) for x in got.collect()] == [("One", 0, 1, "a tip\n\nb", ["tip"])] and (kind, unknown) == ("native_outline", False)
    assert r.key_for("é.pdf") == "gone" and r.sections("Own.pdf", e, p)[0].first().text == "a tip\n\nb\n\nc"
    for file in ("é.pdf", "None.pdf"):
        with pytest.raises(ValueError):
            r.sections(file, e, p)
    got, kind, unknown = r.sections("other.pdf", e, pages(spark, *map(str, range(12))))
    assert (kind, unknown) == ("generic", True) and max(x.end_page for x in got.collect()) == 11
    assert [x.page for x in outline.flagged_pages(got, pages(spark, "x", "widget"), "widget").collect()] == [1]


def test_lookups(spark):
    s = spark.createDataFrame([("g1", "k", "fr", 2), ("g2", "k", "en", 1)], "guid string, source_key string, language string, ord int")
    assert lookups.owner_of(s, "k") == "g2" and lookups.owner_of(s, "k", "fr") == "g1" and lookups.row_by_id(s, "nobody") is None and lookups.row_by_id(s, "g1").ord == 2
    with pytest.raises(LookupError):
        lookups.owner_of(s, "k", "ru")
    p = spark.createDataFrame([("p", "k", "fr", 3)], "guid string, source_key string, language string, page_number int")
    assert lookups.page_of(p, "k", 3).guid == "p" and [r.guid for r in lookups.select_rows(s, {"source_key": "k"}, "ord").collect()] == ["g2", "g1"]
    with pytest.raises(LookupError):
        lookups.page_of(p, "k")


def test_overrides_are_kept_in_the_payload(spark):
    rows = spark.createDataFrame([("g1", '{"a": 1, "manual_rank_reason": "old"}'), ("g2", None)], "guid string, payload string")
    got = {r.guid: r.payload for r in lookups.keep_override(rows, "g1", 0.9, "best").collect()}
    assert got["g2"] is None and lookups.payload_columns(spark.createDataFrame([(got["g1"],)], "payload string"), "payload", {"a": "int", "manual_rank_score": "double", "manual_rank_reason": "string", "no": "boolean"}).drop("payload").first() == (1, 0.9, "best", False)
    with pytest.raises(ValueError):
        lookups.keep_override(rows, "g3", 1, "x")


def test_teardown(spark):
    spark.range(1).createOrReplaceTempView("a_view")
    assert lookups.teardown(spark, ["no_such_table"]) == []


def test_upserts_take_the_last_of_several(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1), (2, "d", 1)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in sync.upsert(old, new, "k", "at").collect()) == [(1, "b"), (2, "d")]
    assert [(r.k, r.v) for r in sync.insert_absent(old, new, "k").collect()] == [(2, "d")]


def test_accepted_markers_against_the_rule(spark):
    import random

    r = random.Random(3)
    lists = [[r.randrange(1, 12) for _ in range(r.randrange(30))] for _ in range(60)]
    df = spark.createDataFrame([(i, [{"n": n} for n in x]) for i, x in enumerate(lists)], "i int, cs array<struct<n: int>>")
    got = {x.i: [c["n"] for c in x.kept] for x in df.select("i", structure.accept_markers(F.col("cs"), F.lit(9)).alias("kept")).collect()}
    for i, x in enumerate(lists):
        run = []
        for k, n in enumerate(x):
            want = (run[-1] if run else 0) + 1
            if n <= 9 and (n == want or (want < n <= want + 3 and want not in x[k + 1 : k + 7])):
                run.append(n)
        assert got[i] == run
