"""Document structure: reading order and links of blocks, sections from outlines, headings or windows, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Block types that are page furniture, and those that are translated.
FURNITURE = ("running_header", "running_footer", "page_number")
UNITS = ("sutra", "paragraph", "heading", "footnote", "list_item", "quote", "caption")

MAX_SECTION_PAGES, WINDOW_PAGES, MIN_HEADINGS, HEADING_RATIO = 40, 10, 5, 1.4


def build_blocks(raw: DataFrame) -> DataFrame:
    """Recognised blocks with ids, offsets and boxes.

    ``raw``: ``source_key, language, page, blocks array<struct<block_id, type, box array<int>, parent_block_id,
    words array<struct<t, box array<int>, lang, style>>, ...>>``.  Words without text or a good box go; words are
    numbered before that.  A block's parent is found by its local id on the page; one that is its own parent has none.
    """
    words = lambda b, bid: F.filter(
        F.transform(
            b["words"],
            lambda w, i: F.struct(
                F.format_string("%s_w%03d", bid, i + 1).alias("id"), w["t"].alias("text"), T.norm_box(w["box"]).alias("bbox"),
                F.when(w["lang"] == "src", F.col("language")).otherwise(F.coalesce(w["lang"], F.lit("other"))).alias("lang"), F.coalesce(w["style"], F.lit("normal")).alias("style"),
            ),
        ),
        lambda w: (F.coalesce(w["text"], F.lit("")) != "") & w["bbox"].isNotNull(),
    )
    # words joined by single spaces: each begins where the ones before end; lambdas bind what is used more than once
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    starts = lambda ws: F.aggregate(ws, F.array(F.lit(0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + F.length(w["text"]) + 1)))
    placed = lambda ws, at: F.transform(ws, lambda w, i: w.withField("char_start", F.get(at, i)).withField("char_end", F.get(at, i) + F.length(w["text"])))
    block = lambda b, i: bound(
        words(b, F.format_string("p%04d_b%03d", F.col("page"), i + 1)), lambda ws: bound(starts(ws), lambda at: bound(placed(ws, at), lambda done: _block(b, i, done)))
    )
    rows = raw.withColumn("blocks", F.transform("blocks", block))
    local = F.map_from_arrays(F.array_distinct(F.transform("blocks", lambda b: b["local_id"])), F.transform(F.array_distinct(F.transform("blocks", lambda b: b["local_id"])), lambda k: F.element_at(F.filter("blocks", lambda b: b["local_id"] == k), -1)["id"]))
    parent = lambda b: F.coalesce(F.try_element_at(F.col("_local"), b["parent_local"]), F.lit(""))
    linked = F.transform("blocks", lambda b: b.withField("parent_block_id", F.when(parent(b) == b["id"], F.lit("")).otherwise(parent(b))).dropFields("parent_local"))
    return rows.withColumn("_local", local).withColumn("blocks", linked).drop("_local")


def _block(b: Column, i: Column, words: Column) -> Column:
    return F.struct(
        F.format_string("p%04d_b%03d", F.col("page"), i + 1).alias("id"), F.coalesce(b["block_id"], F.format_string("b%d", i + 1)).alias("local_id"), F.coalesce(b["type"], F.lit("other")).alias("type"),
        (i + 1).alias("reading_order"), T.norm_box(b["box"]).alias("bbox"), F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), words.alias("words"), F.coalesce(b["parent_block_id"], F.lit("")).alias("parent_local"),
    )


def link_blocks(blocks: DataFrame) -> DataFrame:
    """Numbers and links the blocks of each book in reading order.

    ``blocks``: ``source_key, language, page, reading_order, id, type, parent_block_id, continues_from_previous_page``.
    Furniture has no number.  A book is one ordered window: a few thousand pages.  Parents' levels come by one join.
    """
    book = ["source_key", "language"]
    furniture = F.col("type").isin(*FURNITURE)
    w = Window.partitionBy(*book).orderBy("page", "reading_order", "id")
    main = blocks.filter(~furniture).withColumn("number", F.row_number().over(w))
    last = F.lag(F.struct("id", "page")).over(w)
    main = main.withColumn("prev_id", F.coalesce(F.lag("id").over(w), F.lit(""))).withColumn("next_id", F.coalesce(F.lead("id").over(w), F.lit(""))).withColumn(
        "continues_from", F.when(F.col("continues_from_previous_page") & (last["page"] == F.col("page") - 1), last["id"]).otherwise("")
    )
    parents = main.select(*book, F.col("id").alias("parent_id"), F.col("number").alias("parent_number"), (F.col("parent_block_id") != "").alias("parent_has_parent"))
    kids = main.filter("parent_block_id <> ''").groupBy(*book, F.col("parent_block_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("number", "id"))).alias("kids"))
    linked = main.join(parents.withColumnRenamed("parent_id", "parent_block_id"), [*book, "parent_block_id"], "left").join(kids, [*book, "id"], "left")
    known = F.col("parent_number").isNotNull()
    linked = linked.select(
        *book, "page", "reading_order", "id", "type", "number", F.when(known, F.col("parent_block_id")).otherwise("").alias("parent_id"), "parent_number",
        F.when(~known, 0).when(F.col("parent_has_parent"), 2).otherwise(1).alias("level"), "prev_id", "next_id", "continues_from",
        F.coalesce(F.transform("kids", lambda k: k["id"]), F.array().cast("array<string>")).alias("child_ids"), F.coalesce(F.transform("kids", lambda k: k["number"]), F.array().cast("array<int>")).alias("child_numbers"),
        F.col("type").isin(*UNITS).alias("is_translation_unit"),
    )
    rest = blocks.filter(furniture).select(*book, "page", "reading_order", "id", "type").withColumn("is_translation_unit", F.lit(False))
    return linked.unionByName(rest, allowMissingColumns=True)


def book_index(pages: DataFrame) -> DataFrame:
    """``source_key, language, page, n_blocks, n_words`` to a row for each book: pages, blocks and words."""
    return pages.groupBy("source_key", "language").agg(F.count(F.lit(1)).alias("page_count"), F.sum("n_blocks").alias("blocks"), F.sum("n_words").alias("words"), F.min("page").alias("first_page"))


# ---------------------------------------------------------------- sections


def next_ends(entries: DataFrame, n_pages: Column) -> DataFrame:
    """``doc, idx, start`` with ``end_page``: the next entry's start less one, never before the start."""
    w = Window.partitionBy("doc").orderBy("idx")
    return entries.withColumn("end_page", F.greatest(F.coalesce(F.lead("start").over(w) - 1, n_pages - 1), F.col("start")))


def level_ends(entries: DataFrame, n_pages: Column) -> DataFrame:
    """``doc, idx, level, start`` with ``end_page``: up to the next entry, in list order, of the same level or a higher one.

    One pass over each document from its end: for every level that occurs, the last entry seen of that level or a higher one.
    Levels are few, as headings' are; they are asked for first.
    """
    back = Window.partitionBy("doc").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r[0] for r in entries.select("level").distinct().collect() if r[0] is not None)
    follows = [F.last(F.when(F.col("level") <= k, F.col("start")), ignorenulls=True).over(back).alias(f"_next_{k}") for k in levels]
    nxt = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_next_{k}")) for k in levels], F.lit(None)) if levels else F.lit(None)
    out = entries.select("*", n_pages.alias("_n_pages"), *follows)
    return out.withColumn("end_page", F.greatest(F.coalesce(nxt - 1, F.col("_n_pages") - 1), F.col("start")).cast("int")).drop("_n_pages", *[f"_next_{k}" for k in levels])


def outline_sections(entries: DataFrame, n_pages: Column, levels: tuple[int, int] = (1, 99), ends: str = "next", keep: tuple = (), drop: tuple = (), single_page: tuple = (), strip_chars: str = "") -> DataFrame:
    """Sections of outlines: ``doc, idx, level, title, start`` with ends, kept or dropped by level and whole title.

    Ends are found before entries are dropped, so a kept section ends where a dropped one begins.
    """
    e = entries.withColumn("title", T.clean_title(F.col("title"), strip_chars)).filter(F.col("level").between(*levels))
    if ends == "level":
        order = Window.partitionBy("doc").orderBy("start", "idx")
        e = level_ends(e.withColumn("idx", F.row_number().over(order)), n_pages)
    else:
        e = next_ends(e, n_pages)
    whole = lambda p: F.col("title").rlike(f"^(?:{p})$")
    for p in drop:
        e = e.filter(~whole(p))
    if keep:
        ok = F.lit(False)
        for level, p in keep:
            ok = ok | (whole(p) if level is None else whole(p) & (F.col("level") == level))
        e = e.filter(ok)
    if single_page:
        e = e.withColumn("end_page", F.when(F.col("title").isin(*single_page), F.col("start")).otherwise(F.col("end_page")))
    return e


def fixed_sections(toc: DataFrame, n_pages: Column) -> DataFrame:
    """A table of contents by hand: ``doc, idx, title, page`` (from 1), ``keep``."""
    e = next_ends(toc.withColumn("start", F.col("page") - 1), n_pages)
    return e.filter("keep").drop("page")


def window_sections(docs: DataFrame, size: int = WINDOW_PAGES) -> DataFrame:
    """``doc, n_pages`` to sections of ``size`` pages."""
    starts = docs.filter("n_pages > 0").select("doc", "n_pages", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(size))).alias("start_page"))
    last = F.least(F.col("start_page") + size, F.col("n_pages"))
    return starts.select("doc", F.format_string("Pages %d-%d", F.col("start_page") + 1, last).alias("title"), F.lit(1).alias("level"), "start_page", (last - 1).alias("end_page"))


def split_oversized(sections: DataFrame, most: int = MAX_SECTION_PAGES, even: bool = False) -> DataFrame:
    """Sections of more than ``most`` pages in parts; ``even``: in parts of one size, without a short tail."""
    span = F.col("end_page") - F.col("start_page") + 1
    parts = F.ceil(span / most).cast("int")
    size = F.ceil(span / parts).cast("int") if even else F.lit(most)
    each = sections.withColumn("_n", parts).withColumn("_size", size).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("start_page") + F.col("_k") * F.col("_size")
    many = F.col("_n") > 1
    return (
        each.withColumn("_end", F.when(F.col("_k") == F.col("_n") - 1, F.col("end_page")).otherwise(start + F.col("_size") - 1))
        .withColumn("title", F.when(many, F.format_string("%s (part %d/%d)", F.col("title"), F.col("_k") + 1, F.col("_n"))).otherwise(F.col("title")))
        .withColumn("start_page", start).withColumn("end_page", F.col("_end")).drop("_n", "_size", "_k", "_end")
    )


def section_text(sections: DataFrame, pages: DataFrame, **cleaning) -> DataFrame:
    """Adds the pages' texts, cleaned, in order, two line breaks between. ``pages``: ``doc, page`` (from 0), ``text``."""
    p = pages.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), T.clean_page(F.col("text"), **cleaning).alias("_text"))
    spread = sections.select("doc", "start_page", "end_page", "title", F.explode(F.sequence("start_page", "end_page")).alias("_at"))
    joined = spread.join(p, (F.col("doc") == F.col("_doc")) & (F.col("_at") == F.col("_page"))).groupBy("doc", "start_page", "end_page", "title").agg(F.array_sort(F.collect_list(F.struct("_page", "_text"))).alias("_p"))
    text = joined.select("doc", "start_page", "end_page", "title", T.strip(F.array_join(F.transform("_p", lambda x: x["_text"]), "\n\n")).alias("text"))
    return sections.join(text, ["doc", "start_page", "end_page", "title"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def body_sizes(lines: DataFrame) -> DataFrame:
    """``doc, body``: the size that most characters have; of equals the one seen first."""
    by_size = lines.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "line")).alias("first"))
    return by_size.groupBy("doc").agg(F.min_by("size", F.struct(-F.col("chars"), "first")).alias("body"))


def title_spread(titles: DataFrame) -> DataFrame:
    """``doc, title, on_pages, times``: on how many pages each title stands."""
    return titles.groupBy("doc", "title").agg(F.count_distinct("page").alias("on_pages"), F.count(F.lit(1)).alias("times"))


def reading_offsets(rows: DataFrame, book: list[str], order: str) -> DataFrame:
    """Adds ``char_start``: where each text begins when all of a book stand in order with one character between."""
    w = Window.partitionBy(*book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def font_headings(lines: DataFrame, n_pages: Column, ratio: float = HEADING_RATIO) -> DataFrame:
    """Headings by type size: ``doc, page, line, size, text`` to ``doc, page, title``.

    Body size is the size of most characters (the first seen of equals).  Neighbouring large lines of one size on a page
    are one title; titles on too many pages are running headers; a page has two titles at most.
    """
    sized = lines.withColumn("size", F.round("size", 1))
    body = body_sizes(sized)
    order = Window.partitionBy("doc").orderBy("page", "line")
    large = sized.join(body, "doc").withColumn("large", F.col("size") >= F.col("body") * ratio)
    same = F.lag("large").over(order) & (F.lag("page").over(order) == F.col("page")) & (F.lag("size").over(order) == F.col("size"))
    grouped = large.withColumn("new", F.when(F.col("large") & F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(order)).filter("large")
    titles = grouped.groupBy("doc", "page", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("title"))
    spread = title_spread(titles)
    most = F.greatest(F.lit(3), F.floor(n_pages * 0.03))
    good = titles.join(spread, ["doc", "title"]).filter((F.col("on_pages") <= most) & T.looks_like_heading(F.col("title")))
    per_page = Window.partitionBy("doc", "page").orderBy("g")
    first_two = good.withColumn("k", F.row_number().over(per_page)).filter("k <= 2")
    joined = first_two.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "title"))), lambda x: x["title"]), " / ").alias("title"))
    w = Window.partitionBy("doc").orderBy("page")
    return joined.withColumn("_p", F.lag("title").over(w)).filter("_p IS NULL OR _p <> title").drop("_p")


def fallback_sections(entries: DataFrame, headings: DataFrame, docs: DataFrame) -> DataFrame:
    """Without a rule for a book: its outline at the shallowest of levels 1 to 3 with five entries; else headings; else windows.

    ``docs``: ``doc, n_pages``.  Long sections are split.  ``strategy`` says which it was.
    """
    n = entries.groupBy("doc").agg(*[F.sum((F.col("level") <= k).cast("int")).alias(f"n{k}") for k in (1, 2, 3)])
    depth = n.select("doc", F.when(F.col("n1") >= MIN_HEADINGS, 1).when(F.col("n2") >= MIN_HEADINGS, 2).when(F.col("n3") >= MIN_HEADINGS, 3).alias("depth")).filter("depth IS NOT NULL")
    shallow = entries.join(depth, "doc").filter("level <= depth").join(docs, "doc")
    by_outline = next_ends(shallow, F.col("n_pages")).select("doc", "title", "level", F.col("start").alias("start_page"), "end_page", F.lit("outline").alias("strategy"))
    enough = headings.join(docs, "doc").join(depth, "doc", "left_anti")
    count = Window.partitionBy("doc")
    h = enough.withColumn("k", F.count(F.lit(1)).over(count)).filter((F.col("k") >= MIN_HEADINGS) & (F.col("k") <= F.col("n_pages"))).select("doc", "n_pages", "title", F.col("page").alias("start"))
    front = h.groupBy("doc").agg(F.min("start").alias("s"), F.first("n_pages").alias("n_pages")).filter("s > 0").select("doc", "n_pages", F.lit("Front matter").alias("title"), F.lit(0).alias("start"))
    h = h.unionByName(front)
    by_heading = next_ends(h.withColumn("idx", F.col("start")), F.col("n_pages")).select("doc", "title", F.lit(1).alias("level"), F.col("start").alias("start_page"), "end_page", F.lit("headings").alias("strategy"))
    rest = docs.join(depth, "doc", "left_anti").join(h.select("doc").distinct(), "doc", "left_anti")
    by_window = window_sections(rest).withColumn("strategy", F.lit("windows"))
    return split_oversized(by_outline.unionByName(by_heading).unionByName(by_window))


def page_ranges(pages: DataFrame) -> DataFrame:
    """``doc, page`` (distinct) to ``doc, ranges``: islands of consecutive pages, as in 3-5, 13-14, 20."""
    w = Window.partitionBy("doc").orderBy("page")
    islands = pages.withColumn("island", F.col("page") - F.row_number().over(w)).groupBy("doc", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    return islands.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def accept_markers(candidates: Column, expected: Column) -> Column:
    """Of numbered markers in reading order (``array<struct<n, ...>>``) an increasing run from 1.

    A gap of up to three numbers is allowed where the skipped number isn't among the next six candidates.
    """
    start = F.struct(F.filter(candidates, lambda c: F.lit(False)).alias("kept"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        skipped = F.exists(F.slice(candidates, s["i"] + 2, F.lit(6)), lambda x: x["n"] == s["last"] + 1)
        ok = ((c["n"] == s["last"] + 1) | (c["n"].between(s["last"] + 2, s["last"] + 4) & ~skipped)) & (c["n"] <= expected)
        return F.struct(F.when(ok, F.concat(s["kept"], F.array(c))).otherwise(s["kept"]).alias("kept"), F.when(ok, c["n"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i"))

    return F.aggregate(candidates, start, step, lambda s: s["kept"])


def page_slice(pages: Column, p0: Column, o0: Column, p1: Column, o1: Column) -> Column:
    """Text from (page, offset) to (page, offset) of ``array<string>``; pages and offsets count from 0."""
    page = lambda i: F.get(pages, i)
    inner = F.when(p1 - p0 > 1, F.slice(pages, p0 + 2, p1 - p0 - 1)).otherwise(F.array().cast("array<string>"))
    many = F.array_join(F.concat(F.array(F.substring(page(p0), o0 + 1, F.length(page(p0)))), inner, F.array(F.substring(page(p1), F.lit(1), o1))), "\n\n")
    return F.when(p0 == p1, F.substring(page(p0), o0 + 1, o1 - o0)).otherwise(many)
