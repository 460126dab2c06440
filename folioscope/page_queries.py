"""More named queries, with their SQL: page documents, markup, sections from printed matter, lookups and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import unicode
from .functions import text as T
from .operators import anchors as A
from .operators import chunking, layout, lookups, markup, outline, search, structure, sync, translation
from .oracle import _CLASS, _HEADINGS, _UUID, SQL
from .queries import _documents, _word_boxes, query, table
from .sources import pages as P
from .sources.pages import html_headings

# ---------------------------------------------------------------- page documents


def _raw(spark, d):
    """Conversations as pages of recognised blocks: three turns a page, words in rows of ten, some boxes without a corner."""
    c = table(spark, d, "conversations").withColumn("page", F.floor(F.col("turn") / 3).cast("int"))
    words = F.transform(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w, i: F.struct(w.alias("t"), F.when(i % 7 == 3, F.array(i, i, i)).otherwise(F.array((i / 10).cast("int") * 20 + 15, i % 10 * 100 + 90, (i / 10).cast("int") * 20, i % 10 * 100)).alias("box"), F.when(i % 5 == 0, "src").alias("lang"), F.lit(None).cast("string").alias("style")))
    box = F.array(F.lit(900), F.lit(1200), F.lit(100), F.lit(-5))
    block = F.struct(F.col("turn"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("block_id"), F.when(F.col("role") == "system", "heading").alias("type"), box.alias("box"), F.concat(F.lit("t"), F.greatest(F.col("turn") - 1, F.lit(0)).cast("string")).alias("parent_block_id"), words.alias("words"))
    return c.groupBy(F.col("conv_id").cast("string").alias("source_key"), F.lit("en").alias("language"), "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def _page_docs(spark, d):
    return structure.build_blocks(_raw(spark, d))


@query
def build_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with ids, offsets, boxes and parents: words without a good box go, numbers stay."""
    b = _page_docs(spark, d).select("source_key", "page", F.explode("blocks").alias("b"))
    return b.select(
        "source_key", "page", "b.id", "b.local_id", "b.type", "b.reading_order", F.col("b.bbox.x").alias("x"), F.col("b.bbox.y").alias("y"), F.col("b.bbox.w").alias("w"), F.col("b.bbox.h").alias("h"), F.md5("b.text").alias("text_md5"),
        F.size("b.words").alias("n_words"), F.coalesce(F.array_max(F.transform("b.words", lambda w: w["char_end"])), F.lit(0)).alias("last_end"), "b.parent_block_id",
    )


SQL["build_blocks"] = rf"""WITH t AS (SELECT conv_id::VARCHAR AS source_key, turn // 3 AS page, turn, role, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS ws FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY source_key, page ORDER BY turn) AS o FROM t),
w AS (SELECT source_key, page, turn, i - 1 AS i, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM b)),
g AS (SELECT source_key, page, turn, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM w WHERE i % 7 <> 3 GROUP BY ALL),
f AS (SELECT b.*, format('p{{:04d}}_b{{:03d}}', page, o) AS id FROM b)
SELECT f.source_key, f.page::INT AS page, f.id, 't' || f.turn AS local_id, CASE WHEN f.role = 'system' THEN 'heading' ELSE 'other' END AS type, f.o::INT AS reading_order, 0.0::DOUBLE AS x, 0.1::DOUBLE AS y, 1.0::DOUBLE AS w, 0.8::DOUBLE AS h,
  md5(coalesce(text, '')) AS text_md5, coalesce(n, 0)::INT AS n_words, coalesce(length(text), 0)::INT AS last_end, coalesce(p.id, '') AS parent_block_id
FROM f LEFT JOIN g USING (source_key, page, turn) LEFT JOIN f p ON p.source_key = f.source_key AND p.page = f.page AND p.turn = f.turn - 1"""


@query
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to store of page documents: ids, texts of blocks in order, empty ones left out."""
    return P.page_rows(_page_docs(spark, d)).select("guid", "owner", "page_number", F.md5("text").alias("text_md5"), F.size("blocks").alias("n_blocks"))


SQL["page_rows"] = rf"""WITH t AS (SELECT conv_id::VARCHAR AS k, turn // 3 AS page, turn, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS ws FROM conversations),
b AS (SELECT k, page, turn, coalesce((SELECT string_agg(ws[i], ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(ws) + 1)) AS i) WHERE (i - 1) % 7 <> 3), '') AS text FROM t),
p AS (SELECT k, page, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS text, count(*) AS n FROM b GROUP BY ALL)
SELECT {_UUID("'page:' || k || ':en:' || page")} AS guid, {_UUID("'source:' || k || ':en'")} AS owner, page::INT AS page_number, md5(text) AS text_md5, n::INT AS n_blocks FROM p"""


@query
def stored_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a page at least."""
    return P.source_rows(table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page"))).drop("owner")


SQL["stored_sources"] = f"""SELECT {_UUID("'source:' || source || ':' || lang")} AS guid, source AS source_key, lang AS language, replace(source, '_', ' ') AS title, recognised_pages, first_page
FROM (SELECT source, lang, count(*) AS recognised_pages, min(doc_id) AS first_page FROM documents GROUP BY ALL)"""


@query
def norm_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in thousandths, some inverted, some beyond the page, some short, to fractions."""
    e = F.col("event_id")
    box = F.when(e % 11 == 0, F.array((e % 1000).cast("int"))).otherwise(F.array(*[(e * k % 1300 - 100).cast("int") for k in (7, 13, 29, 31)]))
    return table(spark, d, "events").select("event_id", T.norm_box(box).alias("b")).select("event_id", "b.x", "b.y", "b.w", "b.h")


SQL["norm_boxes"] = """WITH c AS (SELECT event_id, event_id % 11 <> 0 AS good, greatest(0, least(1000, event_id * 7 % 1300 - 100)) AS a, greatest(0, least(1000, event_id * 13 % 1300 - 100)) AS b, greatest(0, least(1000, event_id * 29 % 1300 - 100)) AS c, greatest(0, least(1000, event_id * 31 % 1300 - 100)) AS d FROM events)
SELECT event_id, CASE WHEN good THEN least(b, d) / 1000::DOUBLE END AS x, CASE WHEN good THEN least(a, c) / 1000::DOUBLE END AS y, CASE WHEN good THEN abs(d - b) / 1000::DOUBLE END AS w, CASE WHEN good THEN abs(c - a) / 1000::DOUBLE END AS h FROM c"""


@query
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The least box that holds each page's words, as an aggregation and as an expression over an array."""
    w = _word_boxes(spark, d)
    return layout.block_boxes(w, "page")


SQL["union_boxes"] = r"""WITH w AS (SELECT item_id AS page, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark))
SELECT page, round(min(i % 10) * 0.09 + 0.05, 4)::DOUBLE AS x, 0.05::DOUBLE AS y, round(max(i % 10) * 0.09 + 0.08, 4)::DOUBLE AS w, round((max(i) // 10) * 0.03 + 0.02, 4)::DOUBLE AS h FROM w GROUP BY page"""


@query
def previous_context(spark: SparkSession, d: str) -> DataFrame:
    """The end of what stands on the page before, if there is such a page; documents are pages of their sources, every fourth a footnote."""
    u = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page"), F.lit(1).alias("reading_order"), F.when(F.col("doc_id") % 4 == 0, "footnote").otherwise("paragraph").alias("type"), "text")
    return translation.previous_context(u).withColumn("previous_context", F.md5("previous_context"))


SQL["previous_context"] = "SELECT a.source AS source_key, a.lang AS language, a.doc_id AS page, md5(coalesce(right(b.text, 600), '')) AS previous_context FROM documents a LEFT JOIN documents b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = a.doc_id - 1 AND b.doc_id % 4 <> 0"


@query
def translated_index(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, words and the least scale of each page; a scale that isn't given counts as 1."""
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    block = F.struct(words.alias("words"), F.when(F.col("turn") % 3 != 1, F.struct((1 - F.col("turn") / 100).alias("scale"))).alias("layout"))
    pages = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("source_key"), F.lit("en").alias("language"), F.floor(F.col("turn") / 2).alias("page")).agg(F.collect_list(block).alias("blocks"))
    return sync.translated_index(pages)


SQL["translated_index"] = f"SELECT conv_id::VARCHAR AS source_key, 'en' AS language, turn // 2 AS page, count(*)::INT AS blocks, sum(len(regexp_extract_all(text, '{_CLASS}')))::INT AS words, min(CASE WHEN turn % 3 <> 1 THEN 1 - turn / 100.0::DOUBLE ELSE 1 END) AS min_scale FROM conversations GROUP BY conv_id, turn // 2"


@query
def type_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Type size and line height of pages of words, three of them raised."""
    style = F.when(F.col("ord") % 9 == 4, "sup").otherwise("normal")
    tall = F.col("h") + F.col("ord") % 5 * 0.001
    words = F.array_sort(F.collect_list(F.struct("ord", F.struct("x", "y", "w", tall.alias("h")).alias("bbox"), style.alias("style"))))
    return _word_boxes(spark, d).groupBy("page").agg(words.alias("words")).select("page", translation.type_metrics(F.col("words"), F.lit(1000.0)).alias("m")).select("page", F.round("m.size", 6).alias("size"), F.round("m.line", 6).alias("line"))


SQL["type_metrics"] = r"""WITH w AS (SELECT item_id AS page, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark)),
h AS (SELECT page, i, 20 + i % 5 AS h, i // 10 * 30 + 50 + (20 + i % 5) / 2.0 AS y FROM w),
s AS (SELECT page, 0.86::DOUBLE * median(h) AS size FROM h WHERE i % 9 <> 4 GROUP BY page),
l AS (SELECT page, i // 10 AS line, min(y) AS y FROM h WHERE i % 9 <> 4 GROUP BY ALL),
g AS (SELECT page, lead(y) OVER (PARTITION BY page ORDER BY line) - y AS gap FROM l)
SELECT page, round(size, 6) AS size, round(coalesce(median(gap) FILTER (WHERE gap < 3 * size), 1.25 * size), 6)::DOUBLE AS line FROM g JOIN s USING (page) GROUP BY page, size"""


@query
def block_rects(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of turns as blocks, one below the other: user turns may grow down to the next."""
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("block"), F.lit(0.1).alias("x"), (F.col("turn") * 0.1 + F.col("turn") % 3 * 0.01).alias("y"), F.lit(0.5).alias("w"), F.lit(0.05).alias("h"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), (F.col("role") == "user").alias("grow")
    )
    return translation.block_rects(c, "page").select("page", "block", *[F.round(x, 6).alias(x) for x in ("x0", "y0", "x1", "y1")])


SQL["block_rects"] = """WITH b AS (SELECT conv_id AS page, turn AS block, role = 'user' AS grow, 60.0::DOUBLE AS x0, (turn * 0.1 + turn % 3 * 0.01)::DOUBLE * 800 AS y0, 360.0::DOUBLE AS x1, ((turn * 0.1 + turn % 3 * 0.01)::DOUBLE + 0.05::DOUBLE) * 800 AS y1 FROM conversations)
SELECT page, block, x0, round(y0, 6) AS y0, round(CASE WHEN grow THEN x1 ELSE x1 + 0.2 * (x1 - x0) END, 6)::DOUBLE AS x1,
  round(CASE WHEN grow THEN y1 + greatest(0, least(least(776, coalesce((SELECT min(o.y0) FROM b o WHERE o.page = b.page AND o.block <> b.block AND o.y0 > (b.y0 + b.y1) / 2), 776)) - 2 - y1, 0.6 * (y1 - y0))) ELSE y1 END, 6)::DOUBLE AS y1 FROM b"""


@query
def extract_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of rendered pages dealt to blocks, with languages that are kept and offsets."""
    w = _word_boxes(spark, d)
    layer = w.select("source_key", "page", F.col("ord").alias("word"), "text", *[(F.col(a) * k).alias(n) for a, k, n in (("x", 600, "x0"), ("y", 800, "y0"))], ((F.col("x") + F.col("w")) * 600).alias("x1"), ((F.col("y") + F.col("h")) * 800).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    blocks = w.groupBy("source_key", "page", F.concat(F.lit("b"), F.floor(F.col("ord") / 20).cast("string")).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), F.array_sort(F.collect_list(F.struct("text", F.when(F.col("ord") % 6 == 1, "la").otherwise("en").alias("lang")))).alias("words")
    )
    k = F.substring("block", 2, 9).cast("int")
    rects = blocks.select("source_key", "page", "block", k.alias("ord"), F.lit(0.0).alias("x0"), (k * 48.0 + 38).alias("y0"), F.lit(600.0).alias("x1"), (k * 48.0 + 84).alias("y1"))
    out = translation.extract_page(layer, rects, blocks, "ru")
    return out.select("page", "block", "id", "ord", "text", "char_start", "char_end", (F.col("lang") == "la").alias("kept"))


SQL["extract_words"] = r"""WITH w AS (SELECT item_id AS page, ws[i] AS text, i - 1 AS i FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark))),
k AS (SELECT *, i // 20 AS b, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS f FROM w),
la AS (SELECT DISTINCT page, b, f FROM k WHERE i % 6 = 1 AND f <> ''),
o AS (SELECT k.*, row_number() OVER z AS ord, coalesce(sum(length(text) + 1) OVER (PARTITION BY page, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k WINDOW z AS (PARTITION BY page, b ORDER BY i))
SELECT o.page, 'b' || o.b AS block, format('b{}_w{:03d}', o.b, ord) AS id, ord::INT AS ord, text, s::INT AS char_start, (s + length(text))::INT AS char_end, la.f IS NOT NULL AS kept FROM o LEFT JOIN la USING (page, b, f)"""


# ---------------------------------------------------------------- markup and text


def _marked_words(spark, d):
    """Benchmark words with languages and styles by place; each fifth word ends in a hyphen at a line's end."""
    text = F.when(F.col("ord") % 10 == 9, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    w = _word_boxes(spark, d).select("page", "ord", text.alias("text"), F.when(F.col("ord") % 8 < 2, "sa").otherwise("en").alias("lang"), F.when(F.col("ord") % 13 == 6, "sup").otherwise("normal").alias("style"), F.struct("x", "y", "w", "h").alias("bbox"))
    return w.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text", "lang", "style", "bbox"))), lambda x: x.dropFields("ord")).alias("words"))


@query
def joined_words(spark: SparkSession, d: str) -> DataFrame:
    """Words broken at lines' ends put together again."""
    return _marked_words(spark, d).select("page", F.array_join(F.transform(markup.dehyphenate(F.col("words")), lambda w: w["text"]), " ").alias("text")).select("page", F.md5("text").alias("text_md5"))


SQL["joined_words"] = r"""WITH w AS (SELECT item_id AS page, ws[i] AS t, i - 1 AS i, len(ws) AS n FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark))),
j AS (SELECT page, i, t, i % 10 = 9 AND coalesce(regexp_matches(lead(t) OVER (PARTITION BY page ORDER BY i), '^\p{Ll}'), FALSE) AS joins FROM w)
SELECT page, md5(rtrim(string_agg(CASE WHEN joins THEN t WHEN i % 10 = 9 THEN t || '- ' ELSE t || ' ' END, '' ORDER BY i), ' ')) AS text_md5 FROM j GROUP BY page"""


@query
def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: characters, patterns and lines out, blanks collapsed, call-outs found."""
    text = T.clean_page(F.col("text"), strip_chars="|%", strip_text=("License[^\n]*",), strip_lines=("[A-Z][a-z]+\\.", "\\d+"), collapse_spaces=True)
    tags = T.callouts(F.col("text"), {"license": "(?i)licen[sc]e", "mail": "@", "number": "\\d{4}"})
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("text_md5"), F.array_join(tags, ",").alias("tags"))


SQL["cleaned_pages"] = r"""WITH a AS (SELECT doc_id, text, regexp_replace(translate(text, '|%', '  '), 'License[^\n]*', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, text, list_filter(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: NOT regexp_full_match(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[A-Z][a-z]+\.|\d+')) AS ls FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5,
  array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '\d{4}') THEN 'number' END], lambda x: x IS NOT NULL), ',') AS tags FROM l"""


@query
def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages without their numbers and garbled markers, blank lines squeezed."""
    text = F.concat(F.lit("- 12 -\n"), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")), F.lit("  \nx ; 7 ; \nend"))
    return table(spark, d, "documents").select("doc_id", F.md5(outline.clean_marked(text)).alias("text_md5"))


SQL["marked_pages"] = r"""WITH t AS (SELECT doc_id, '- 12 -' || chr(10) || replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) || '  ' || chr(10) || 'x ; 7 ; ' || chr(10) || 'end' AS t FROM documents),
l AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: NOT (regexp_matches(x, '^\s*-\s*\d+\s*$') OR (length(x) < 160 AND regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), ';\s*\d{1,2}\s*;\s*$')))), lambda x: regexp_replace(x, '\s+$', '')) AS ls FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(translate(array_to_string(ls, chr(10)), 'æÆÒ†‡◊ÌºÚŸ®©Ω∂', 'āĀṣṭśṇḥūīĪṛṅŚḍ'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM l"""


@query
def short_answers(spark: SparkSession, d: str) -> DataFrame:
    """Yes or no of replies, wherever the line stands."""
    line = F.when(F.col("turn") % 3 == 0, F.lit("\nshort answer: YES \n")).when(F.col("turn") % 3 == 1, F.lit("\nShort answer: no\nmore")).otherwise(F.lit("Short answer: Yes, maybe"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.short_answer(F.concat("text", line)).alias("short"))


SQL["short_answers"] = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS short FROM conversations"


# ---------------------------------------------------------------- sections


@query
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of sections of ten pages: documents as books, their lines as pages."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    n = lines.groupBy("doc").agg((F.max("page") + 1).alias("n_pages"))
    return structure.section_text(structure.window_sections(n), lines).select("doc", "start_page", "end_page", F.md5("text").alias("text_md5"))


SQL["section_texts"] = r"""WITH l AS (SELECT doc_id AS doc, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS page FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc, (page // 10 * 10)::INT AS start_page, max(page)::INT AS end_page, md5(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page), '^\s+|\s+$', '', 'g')) AS text_md5 FROM l GROUP BY doc, page // 10"""


def _sized_lines(spark, d):
    """Lines of documents as typeset: every seventh is large, and so is a line after one of those in documents of even number."""
    l = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))  # noqa: E741
    large = (F.col("i") % 7 == 0) | ((F.col("i") % 7 == 1) & (F.col("doc") % 2 == 0))
    return l.select("doc", F.floor(F.col("i") / 5).cast("int").alias("page"), F.col("i").alias("line"), F.when(large, 16.04).otherwise(10.02).alias("size"), "text")


@query
def font_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings by type size, neighbours joined, running headers and third titles out."""
    return structure.font_headings(_sized_lines(spark, d), F.lit(100)).select("doc", "page", F.md5("title").alias("title_md5"))


SQL["font_headings"] = r"""WITH l AS (SELECT doc_id AS doc, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT doc, i, i // 5 AS page, t AS text, (i % 7 = 0) OR (i % 7 = 1 AND doc % 2 = 0) AS big FROM l),
z AS (SELECT doc, big, sum(length(text)) AS chars, min(i) AS first FROM s GROUP BY ALL),
y AS (SELECT doc, big AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, first) AS k FROM z) WHERE k = 1),
h AS (SELECT s.doc, s.page, CASE WHEN i % 7 = 1 AND (i - 1) // 5 = page THEN i - 1 ELSE i END AS g, string_agg(text, ' ' ORDER BY i) AS title FROM s JOIN y USING (doc) WHERE big AND NOT body GROUP BY ALL),
n AS (SELECT doc, title, count(DISTINCT page) AS pages FROM h GROUP BY ALL),
q AS (SELECT h.*, row_number() OVER (PARTITION BY doc, page ORDER BY g) AS k FROM h JOIN n USING (doc, title) WHERE pages <= 3 AND length(title) BETWEEN 1 AND 100 AND len(regexp_extract_all(title, '\p{L}')) >= 3 AND regexp_matches(title, '^[\p{Lu}\p{Lt}\p{Nd}]')),
j AS (SELECT doc, page, string_agg(title, ' / ' ORDER BY g) AS title FROM q WHERE k <= 2 GROUP BY ALL)
SELECT doc, page::INT AS page, md5(title) AS title_md5 FROM (SELECT *, lag(title) OVER (PARTITION BY doc ORDER BY page) AS p FROM j) WHERE p IS NULL OR p <> title"""


def _book_pages(spark, d):
    """Documents as books with a printed table of contents: a title page, the contents, then a page for each line, five at most."""
    l = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))  # noqa: E741
    body = l.select("doc", (F.col("i") + 2).alias("page"), F.concat(F.lit("Chapter "), (F.col("i") / 2).cast("int").cast("string"), F.lit(" Summary\n"), F.md5("line")).alias("text"))
    n = l.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    entry = lambda k: F.concat(F.format_string("%d.%d Part ", F.floor(k / 3).cast("int") + 1, k % 3 + 1), k.cast("string"), F.lit("\n"), (F.floor(k / 2) * 2 + 7).cast("string"))
    toc = n.select("doc", F.lit(1).alias("page"), F.concat(F.lit("Contents\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") + 1), entry), "\n")).alias("text"))
    return n.select("doc", F.lit(0).alias("page"), F.lit("A title").alias("text")).unionByName(toc).unionByName(body)


@query
def contents_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by printed tables of contents: of entries on one page the last, and a constant offset."""
    return outline.contents_sections(_book_pages(spark, d)).select("doc", "title", "level", "start_page", "end_page")


SQL["contents_sections"] = """WITH n AS (SELECT doc_id AS doc, len(string_split(text, chr(10))) AS n FROM documents),
e AS (SELECT doc, n, k, k // 2 * 2 + 7 AS p FROM (SELECT *, unnest(range(0, n + 2)) AS k FROM n)),
f AS (SELECT doc, n, k, p, lead(p) OVER (PARTITION BY doc ORDER BY k) AS nxt FROM e),
g AS (SELECT doc, n, k, p - 7 + 2 AS a FROM f WHERE nxt IS NULL OR nxt <> p),
h AS (SELECT *, greatest(0, least(a, n + 1)) AS s, greatest(coalesce(lead(a) OVER (PARTITION BY doc ORDER BY k) - 1, n + 1), a) AS e FROM g)
SELECT doc, (k // 3 + 1) || '.' || (k % 3 + 1) || ' Part ' || k AS title, 2 AS level, s::INT AS start_page, greatest(s, least(e, n + 1))::INT AS end_page FROM h"""


@query
def chapter_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by chapter headings, the last one up to what stands behind it."""
    pages = _book_pages(spark, d)
    n = pages.groupBy("doc").agg((F.max("page") + 1).alias("page"))
    behind = n.select("doc", "page", F.lit("Quiz and test").alias("text")).unionByName(n.select("doc", (F.col("page") + 2).alias("page"), F.lit("Index of words").alias("text"))).unionByName(n.select("doc", (F.col("page") + 1).alias("page"), F.lit("more").alias("text")))
    return outline.chapter_sections(pages.unionByName(behind), "Chapter (\\d+) Summary", {"quiz": "^Quiz", "index": "^Index"})


SQL["chapter_sections"] = """WITH l AS (SELECT doc_id AS doc, len(string_split(text, chr(10))) AS n FROM documents),
c AS (SELECT doc, n, k, 2 * k + 2 AS s FROM (SELECT *, unnest(range(0, (n + 1) // 2)) AS k FROM l))
SELECT doc, 'Chapter ' || k AS title, NULL::VARCHAR AS tag, s::INT AS start_page, coalesce(lead(s) OVER (PARTITION BY doc ORDER BY k) - 1, n + 1)::INT AS end_page FROM c
UNION ALL SELECT doc, 'quiz', 'quiz', (n + 2)::INT, (n + 3)::INT FROM l UNION ALL SELECT doc, 'index', 'index', (n + 4)::INT, (n + 4)::INT FROM l"""


@query
def page_slices(spark: SparkSession, d: str) -> DataFrame:
    """Text from the fourth character of the second line up to the third of the last."""
    p = F.split("text", "\n")
    last = F.size(p) - 1
    return table(spark, d, "documents").filter(F.size(p) > 1).select("doc_id", F.md5(structure.page_slice(p, F.lit(1), F.lit(3), last, F.when(last == 1, 9).otherwise(2))).alias("slice_md5"))


SQL["page_slices"] = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, md5(CASE WHEN len(ls) = 2 THEN substr(ls[2], 4, 6) ELSE array_to_string(list_concat([substr(ls[2], 4)], ls[3:len(ls) - 1], [substr(ls[len(ls)], 1, 2)]), chr(10) || chr(10)) END) AS slice_md5 FROM l WHERE len(ls) > 1"""


@query
def accepted_markers(spark: SparkSession, d: str) -> DataFrame:
    """Numbered markers of each user's events in order: an increasing run, small gaps only where the number doesn't come soon."""
    n = (F.col("event_id") % 7 * 2 + F.col("value") % 5).cast("int") % 12 + 1
    lists = table(spark, d, "events").select("user_id", F.struct("event_id", n.alias("n")).alias("c")).groupBy("user_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    kept = structure.accept_markers(F.col("cs"), F.lit(10))
    return lists.select("user_id", F.array_join(F.transform(kept, lambda c: c["n"].cast("string")), ",").alias("run"))


# ---------------------------------------------------------------- chunks


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents as pages, with ids that follow from the pages'."""
    pages = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("guid"), F.col("source").alias("owner"), F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page_number"), "text", F.split("text", "\n").alias("blocks"))
    return chunking.chunk_rows(pages).select("guid", "parent", "ord", F.md5("text").alias("text_md5"))


SQL["page_chunks"] = f"""WITH packed AS ({SQL["chunk_pack"]}),
sizes AS (SELECT doc_id, text, len(regexp_extract_all(text, '{_CLASS}')) AS n FROM documents WHERE regexp_matches(text, '\\S')),
c AS (SELECT doc_id::VARCHAR AS parent, ord, chunk_md5 FROM packed p JOIN sizes s ON s.doc_id = p.guid WHERE n > 500 UNION ALL SELECT doc_id::VARCHAR, 0, md5(text) FROM sizes WHERE n <= 500)
SELECT {_UUID("'chunk:' || parent || ':' || ord")} AS guid, parent, ord::INT AS ord, chunk_md5 AS text_md5 FROM c"""


# ---------------------------------------------------------------- lookups and stored tables


@query
def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns of the events' JSON payload."""
    rows = table(spark, d, "events").withColumn("payload", F.to_json(F.struct((F.col("event_id") % 9).alias("n"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, F.lit(True)).alias("done"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("bad"))))
    return lookups.payload_columns(rows.select("event_id", "payload"), "payload", {"n": "int", "kind": "string", "done": "boolean", "bad": "int", "absent": "string"}).drop("payload")


SQL["payload_fields"] = "SELECT event_id, (event_id % 9)::INT AS n, event_type AS kind, event_id % 4 = 0 AS done, NULL::INT AS bad, NULL::VARCHAR AS absent FROM events"


@query
def merged_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A rank set by hand merged into JSON payloads: new keys take the old ones' place."""
    old = F.to_json(F.struct(F.col("label").cast("string").alias("label"), F.lit("old").alias("manual_rank_reason")))
    merged = lookups.merge_payload(old, F.to_json(F.struct((F.col("vec_id") % 5).cast("string").alias("manual_rank_score"), F.lit("best").alias("manual_rank_reason"))))
    rows = table(spark, d, "embeddings").select("vec_id", merged.alias("payload"))
    return lookups.payload_columns(rows, "payload", {"label": "string", "manual_rank_score": "string", "manual_rank_reason": "string"}).drop("payload")


SQL["merged_payloads"] = "SELECT vec_id, label::VARCHAR AS label, (vec_id % 5)::VARCHAR AS manual_rank_score, 'best' AS manual_rank_reason FROM embeddings"


@query
def owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sources by key, with and without a language: the first language, or none."""
    docs = table(spark, d, "documents")
    sources = docs.select(F.col("source").alias("source_key"), F.col("lang").alias("language")).distinct().withColumn("guid", F.concat_ws(":", "source_key", "language"))
    keys = docs.select(F.col("source").alias("source_key")).distinct()
    wanted = keys.withColumn("language", F.lit(None).cast("string")).unionByName(keys.withColumn("language", F.lit("fr"))).unionByName(spark.createDataFrame([("nowhere", "fr")], "source_key string, language string"))
    return lookups.owners_of(wanted, sources)


SQL["owner_lookup"] = """WITH s AS (SELECT DISTINCT source, lang FROM documents), k AS (SELECT DISTINCT source FROM s)
SELECT source AS source_key, NULL::VARCHAR AS language, min(source || ':' || lang) AS guid FROM s GROUP BY source
UNION ALL SELECT k.source, 'fr', CASE WHEN s.lang IS NOT NULL THEN k.source || ':fr' END FROM k LEFT JOIN s ON s.source = k.source AND s.lang = 'fr' UNION ALL SELECT 'nowhere', 'fr', NULL"""


@query
def rows_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Many lookups by id in one join, with the pages behind each row."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("guid"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 100).alias("page"), "lang")
    ids_ = table(spark, d, "pages").select((F.col("page_id") * 7).alias("guid"))
    expanded = F.when(F.col("guid") % 4 == 0, F.col("guid") % 10)
    return lookups.rows_by_ids(ids_, docs).select("guid", "lang", F.array_join(lookups.page_numbers(F.col("page"), expanded), ",").alias("pages"))


SQL["rows_by_id"] = """SELECT page_id * 7 AS guid, d.lang, coalesce((CASE WHEN page_id * 7 % 4 = 0 THEN page_id * 7 % 10 WHEN d.doc_id % 6 <> 0 THEN d.doc_id % 100 END)::VARCHAR, '') AS pages
FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 7"""


@query
def source_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of sources of one language."""
    docs = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page"))
    s = P.source_rows(docs).withColumn("page_count", F.col("recognised_pages") + 1).withColumn("ord", F.length("source_key"))
    return lookups.sources_list(s, "en").drop("guid")


SQL["source_list"] = "SELECT source AS source_key, lang AS language, replace(source, '_', ' ') AS title, count(*) + 1 AS page_count, count(*) AS recognised_pages, min(doc_id) AS first_page, length(source)::INT AS ord FROM documents WHERE lang = 'en' GROUP BY source, lang"


@query
def book_status(spark: SparkSession, d: str) -> DataFrame:
    """The first source whose key is like a pattern: pages, chunks, complete, ready."""
    docs = table(spark, d, "documents")
    key = F.concat_ws(":", "source", "lang")
    sources = docs.groupBy(F.col("source").alias("source_key"), F.col("lang").alias("language"), key.alias("guid")).agg(F.count(F.lit(1)).alias("page_count"))
    pages = docs.select(key.alias("owner"))
    return sync.book_status(sources, pages, pages.unionByName(pages), "%S%")


SQL["book_status"] = "SELECT source AS source_key, lang AS language, source || ':' || lang AS guid, count(*) AS page_count, count(*) AS pages, 2 * count(*) AS chunks, TRUE AS complete, TRUE AS ready FROM documents WHERE source ILIKE '%S%' GROUP BY source, lang ORDER BY source, lang LIMIT 1"


@query
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """What stays of pages and chunks when some sources go."""
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("guid"), F.col("source").alias("owner"))
    gone = docs.select(F.col("source").alias("guid")).distinct().filter(F.length("guid") % 2 == 0)
    kept_pages, kept_chunks = sync.cascade(gone, pages, pages.withColumn("guid", F.col("guid") * 10))
    return kept_pages.select(F.lit("page").alias("kind"), "guid").unionByName(kept_chunks.select(F.lit("chunk").alias("kind"), "guid"))


SQL["cascade"] = "SELECT 'page' AS kind, doc_id AS guid FROM documents WHERE length(source) % 2 = 1 UNION ALL SELECT 'chunk', doc_id * 10 FROM documents WHERE length(source) % 2 = 1"


@query
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and the pages that are not done yet, as rows of one key."""
    return sync.first_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


SQL["first_per_key"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1"


@query
def remaining_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents without those that are to go, and pages of a window that aren't done."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("guid"))
    left = sync.delete(docs, table(spark, d, "labels").select(F.col("doc_id").alias("guid")).distinct(), "guid").select(F.lit("stored").alias("kind"), "guid")
    todo = P.pages_to_do(spark, 0, 500, table(spark, d, "pages").select(F.col("page_id").cast("int").alias("page"))).select(F.lit("to do").alias("kind"), F.col("page").cast("long").alias("guid"))
    return left.unionByName(todo)


SQL["remaining_rows"] = "SELECT 'stored' AS kind, doc_id AS guid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'to do', i FROM (SELECT unnest(range(0, 501)) AS i) WHERE i NOT IN (SELECT page_id FROM pages)"


@query
def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Languages and relations that every store begins with."""
    from .plans import catalog

    languages = catalog.languages(spark).select(F.lit("language").alias("kind"), "code", F.col("prompt_name").alias("value"))
    return languages.unionByName(catalog.relations(spark).select("kind", F.concat_ws(".", "subject", "part").alias("code"), F.concat_ws(" ", "predicate", "object").alias("value")))


SQL["seeds"] = """SELECT * FROM (VALUES ('language', 'fr', 'French'), ('language', 'en', 'American English (US)'), ('language', 'ru', 'Russian'), ('external_mapping', 'expression.language', 'equivalentTo dc:language'),
('external_mapping', 'expression.title', 'equivalentTo dc:title'), ('association', 'sources.first', 'hasAgent attributed author')) AS t(kind, code, value)"""


@query
def composed_text(spark: SparkSession, d: str) -> DataFrame:
    """File names in one Unicode form."""
    return _documents(spark, d).select("guid", F.md5(unicode.nfc_column(F.concat("text", F.lit("é")))).alias("nfc_md5"))


SQL["composed_text"] = "SELECT doc_id AS guid, md5(nfc_normalize(text || 'e' || chr(769))) AS nfc_md5 FROM documents"

SQL["page_titles"] = r"""SELECT page_id, CASE WHEN s = '' THEN 'source' ELSE s END AS slug, md5(t) AS title_md5 FROM (
  SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s, trim(regexp_replace(translate(html, '<>/', '   '), '\s+', ' ', 'g')) AS t FROM pages)"""
SQL["cut_texts"] = r"SELECT doc_id, (CASE WHEN length(text) <= 1000 THEN length(text) ELSE length(regexp_replace(text[1:1000], '\s+$', '')) + 40 END)::INT AS cut_chars FROM documents"
SQL["romanize"] = "SELECT item_id, md5(text || ' ahiṃsā') AS romanized_md5 FROM benchmark"
SQL["fold_text"] = "SELECT doc_id AS guid, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS folded_md5 FROM documents"
SQL["accepted_markers"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, trunc(event_id % 7 * 2 + value % 5)::INT % 12 + 1 AS n FROM events), l AS (SELECT user_id, list(n ORDER BY event_id) AS cs FROM e GROUP BY user_id),
s AS (SELECT user_id, cs, 0 AS i, 0 AS last, []::INT[] AS run FROM l UNION ALL
  SELECT user_id, cs, i + 1, CASE WHEN ok THEN n ELSE last END, CASE WHEN ok THEN list_append(run, n) ELSE run END
  FROM (SELECT *, cs[i + 1] AS n, cs[i + 1] <= 10 AND (cs[i + 1] = last + 1 OR (cs[i + 1] BETWEEN last + 2 AND last + 4 AND NOT list_contains(cs[i + 2:i + 7], last + 1))) AS ok FROM s WHERE i < len(cs)))
SELECT user_id, array_to_string(run, ',') AS run FROM s WHERE i = len(cs)"""
# of two equal words on a line, one of which the layer lacks, the later one is paired
SQL["align_words"] = r"""WITH w AS (SELECT item_id AS page, ws[i] AS text, i - 1 AS ord FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM benchmark))),
f AS (SELECT *, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS f FROM w),
t AS (SELECT *, ord % 7 = 3 AND ord % 10 > 0 AND f <> '' AND f = lag(f) OVER (PARTITION BY page ORDER BY ord) AS takes FROM f),
g AS (SELECT *, coalesce(lead(takes) OVER (PARTITION BY page ORDER BY ord), FALSE) AS gives FROM t),
m AS (SELECT *, (ord % 7 = 3 AND NOT coalesce(takes, FALSE)) OR gives AS own FROM g)
SELECT page, ord, text, round((CASE WHEN takes THEN ord - 1 ELSE ord END) % 10 * 0.09 + 0.05 + CASE WHEN own THEN 0 ELSE 0.004 END, 4)::DOUBLE AS x, round(ord // 10 * 0.03 + 0.05, 4)::DOUBLE AS y,
  CASE WHEN own THEN 'recogniser' ELSE 'pdf_text_layer' END AS bbox_source FROM m"""


# ---------------------------------------------------------------- anchors


@query
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Headings of the pages, some letters garbled, found again in the pages' texts: paragraphs are pages, tags end lines."""
    html = table(spark, d, "pages").select(F.col("page_id").alias("doc"), "html")
    parts = html.select("doc", F.posexplode(F.split("html", "</p>")).alias("page", "text")).withColumn("text", F.regexp_replace("text", "<[^>]*>", "\n"))
    titles = html_headings(table(spark, d, "pages")).select(F.col("page_id").alias("doc"), "idx", F.translate("title", "oe", "0c").alias("title"))
    return A.spans(A.anchors(parts, titles, 500)).select("doc", "idx", F.md5("title").alias("title_md5"), "page", "off", "score", "end_page", "end_off")


_FOLDED = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
_GRAMS = "CASE WHEN length({0}) > 0 THEN list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3))) ELSE [] END"
# the chain: each candidate after the best of those before it, then back from the greatest sum
SQL["anchors"] = rf"""WITH RECURSIVE titles AS (
  SELECT doc, idx, translate(title, 'oe', '0c') AS title FROM {_HEADINGS}
), lines AS (
  SELECT doc, page, line, sum(length(line) + 1) OVER (PARTITION BY doc, page ORDER BY i) - length(line) - 1 AS off
  FROM (SELECT doc, page, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT doc, page, string_split(regexp_replace(text, '<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM (SELECT page_id AS doc, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS page FROM (SELECT page_id, string_split(html, '</p>') AS ps FROM pages))))
), t AS (
  SELECT doc, idx, {_GRAMS.format("f")} AS g FROM (SELECT doc, idx, {_FOLDED.format("title")} AS f FROM titles)
), x AS (
  SELECT doc, page, off, {_GRAMS.format("f")} AS g FROM (SELECT doc, page, off, {_FOLDED.format("line")} AS f FROM lines)
), c AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, off, idx) - 1 AS nr, count(*) OVER (PARTITION BY doc) AS n
  FROM (SELECT t.doc, idx, page, off, 2000 * len(list_intersect(t.g, x.g)) // (len(t.g) + len(x.g)) AS score FROM t JOIN x ON t.doc = x.doc AND len(t.g) > 0 AND len(x.g) > 0) WHERE score >= 500
), dp AS (
  SELECT DISTINCT doc, 0::BIGINT AS step, n, []::STRUCT(nr BIGINT, idx BIGINT, page BIGINT, off BIGINT, score BIGINT, key BIGINT, prev BIGINT)[] AS s FROM c
  UNION ALL
  SELECT doc, step + 1, n, list_append(s, {{'nr': nr, 'idx': idx, 'page': page, 'off': off, 'score': score, 'key': (score + ceil(coalesce(top, 0) / 1000000.0)) * 1000000 - nr, 'prev': CASE WHEN top IS NULL THEN -1 ELSE ceil(top / 1000000.0) * 1000000 - top END}})
  FROM (SELECT dp.doc, dp.step, dp.n, dp.s, c.nr, c.idx, c.page, c.off, c.score,
    list_max(list_transform(list_filter(dp.s, lambda p: p.idx < c.idx AND (p.page < c.page OR (p.page = c.page AND p.off < c.off))), lambda p: p.key)) AS top FROM dp JOIN c ON c.doc = dp.doc AND c.nr = dp.step)
), done AS (
  SELECT doc, s, list_max(list_transform(s, lambda p: p.key)) AS top FROM dp WHERE step = n
), back AS (
  SELECT doc, s, s[(ceil(top / 1000000.0) * 1000000 - top)::BIGINT + 1] AS p FROM done
  UNION ALL SELECT doc, s, s[p.prev + 1] FROM back WHERE p.prev >= 0
)
SELECT doc, idx, md5(title) AS title_md5, page, off, score, lead(page) OVER w AS end_page, lead(off) OVER w AS end_off
FROM (SELECT b.doc, t.idx, t.title, p.page::INT AS page, p.off::INT AS off, p.score::INT AS score FROM back b JOIN titles t ON t.doc = b.doc AND t.idx = b.p.idx) WINDOW w AS (PARTITION BY doc ORDER BY page, off)"""


# ---------------------------------------------------------------- operators by themselves


@query
def marked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's words as a block: of seven the last two of a kept language, every ninth raised, all on one line."""
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    one = lambda w, i: F.struct(w.alias("text"), F.when(i % 7 >= 5, "sa").otherwise("en").alias("lang"), F.when(i % 9 == 8, "sup").otherwise("normal").alias("style"), F.struct(F.lit(0.1).alias("y"), F.lit(0.02).alias("h")).alias("bbox"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(markup.mark_source(F.transform(words, one))).alias("marked_md5"))


SQL["marked_sources"] = r"""WITH w AS (
  SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS ws FROM conversations)
), m AS (
  SELECT conv_id, turn, i, CASE WHEN i % 7 = 5 THEN '[[' || w || CASE WHEN i + 1 = n THEN ']]' ELSE '' END WHEN i % 7 = 6 THEN w || ']]' WHEN i % 9 = 8 THEN '<sup>' || w || '</sup>' ELSE w END AS x FROM w
)
SELECT c.conv_id, c.turn, md5(replace(coalesce(t, ''), chr(173), '')) AS marked_md5 FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS t FROM m GROUP BY ALL) USING (conv_id, turn)"""


@query
def markup_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose paragraphs are marked, as HTML."""
    t = F.replace(F.replace("html", F.lit("<p>"), F.lit("[[")), F.lit("</p>"), F.lit("]]"))
    return table(spark, d, "pages").select("page_id", F.md5(unicode.markup_html_column(t)).alias("html_md5"))


SQL["markup_html"] = r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(html, '<p>', '[['), '</p>', ']]'), chr(173), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\[\[(.+?)\]\]', '<i>\1</i>', 'gs')) AS html_md5 FROM pages"""


@query
def even_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents' words as pages, in even parts of at most forty."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.lit(1).alias("level"), F.lit(0).alias("start_page"), (chunking.whitespace_tokens(F.col("text")) - 1).alias("end_page"))
    return structure.split_oversized(rows.filter("end_page >= 0"), even=True)


SQL["even_sections"] = f"""SELECT doc, level, CASE WHEN n > 1 THEN title || ' (part ' || (k + 1) || '/' || n || ')' ELSE title END AS title, (k * size)::INT AS start_page, (CASE WHEN k = n - 1 THEN words ELSE (k + 1) * size END - 1)::INT AS end_page
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, ceil(words / n::DOUBLE)::BIGINT AS size FROM (SELECT *, ceil(words / 40.0)::BIGINT AS n FROM (SELECT doc_id AS doc, source AS title, 1 AS level, len(regexp_extract_all(text, '{_CLASS}'))::INT AS words FROM documents) WHERE words > 0)))"""


@query
def fixed_contents(spark: SparkSession, d: str) -> DataFrame:
    """The pages' headings as a table of contents by hand, every third left out after ends are found."""
    h = html_headings(table(spark, d, "pages")).select(F.col("page_id").alias("doc"), "idx", "title", (2 * F.col("idx") + 1).alias("page"), (F.col("idx") % 3 != 1).alias("keep"))
    n = h.groupBy("doc").agg((F.max("page") + 4).alias("n_pages"))
    return structure.fixed_sections(h.join(n, "doc"), F.col("n_pages")).select("doc", "idx", "title", "start", "end_page")


SQL["fixed_contents"] = f"""SELECT doc, idx, title, start, end_page FROM (
  SELECT doc, idx, title, start, greatest(coalesce(lead(start) OVER (PARTITION BY doc ORDER BY idx) - 1, max(start) OVER (PARTITION BY doc) + 4), start)::INT AS end_page FROM {_HEADINGS}) WHERE idx % 3 <> 1"""


@query
def or_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", search.or_queries(F.col("text")).alias("or_query"))


SQL["or_queries"] = r"""SELECT item_id, coalesce(array_to_string(nullif(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda w: w <> ''), []), ' OR '), text) AS or_query FROM benchmark"""
