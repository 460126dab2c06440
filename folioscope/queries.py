"""Named queries over the driver's tables, one for each group of operators.

``documents`` stand for pages and chunks (``doc_id`` is the guid, ``source`` the owner, lines are blocks), ``embeddings``
for chunk vectors (``label`` is the owner), ``benchmark`` for questions, ``pages`` for documents with headings,
``conversations`` for ordered blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids, unicode
from .functions import text as T
from .operators import chunking, dense, keywords, layout, search, structure, sync
from .plans import catalog
from .sources.pages import html_headings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("guid"), F.col("label").alias("owner"), "embedding")


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("guid"), F.col("source").alias("owner"), F.col("lang").alias("language"), "text")


def _terms(spark, d):
    return search.terms_of(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _nine(c: str):
    return F.round(c, 9).alias(c)


# ---------------------------------------------------------------- search


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of one vector: a top-k without a window over all rows."""
    v = _vectors(spark, d)
    vector = v.filter("guid = 0").first()["embedding"]
    return search.dense_search_one(v, vector, 20).select(F.lit(0).cast("long").alias("query_id"), "guid", _nine("cosine_distance"), "rank")


@query
def dense_topk_owner(spark: SparkSession, d: str) -> DataFrame:
    """The same within one owner: the filter reaches the scan."""
    v = _vectors(spark, d)
    one = v.filter("guid = 0").select(F.col("guid").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense_search(v, one, 20, owner=3).select("query_id", "guid", _nine("cosine_distance"), "rank")


def _batch(spark, d):
    v = _vectors(spark, d)
    return v, v.filter("guid % 50 = 0").select(F.col("guid").alias("query_id"), F.col("embedding").alias("vector"))


@query
def dense_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Many questions in one plan: every fiftieth vector against all."""
    v, q = _batch(spark, d)
    return search.dense_search(v, q, 20).select("query_id", "guid", _nine("cosine_distance"), "rank")


@query
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    """The same questions on an index of inverted lists, all lists of one owner asked: exact."""
    v, q = _batch(spark, d)
    return dense.index_search(spark, dense.new_index(v), q, 20, owner=3, exact=True).select("query_id", "guid", _nine("cosine_distance"), "rank")


@query
def dense_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of exact search's results the index finds by default, and how many rows each question gets of one owner."""
    v, q = _batch(spark, d)
    folder = dense.new_index(v)
    exact, found = (x.select("query_id", "guid") for x in (search.dense_search(v, q, 20), dense.index_search(spark, folder, q, 20)))
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "guid"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
    own = dense.index_search(spark, folder, q, 20, owner=3).groupBy("query_id").agg(F.count(F.lit(1)).alias("of_owner"))
    return hits.join(own, "query_id").agg(F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("found_nine_of_ten"), F.min("of_owner").alias("fewest_of_owner"))


@query
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents by matching words, for all benchmark questions at once."""
    return search.keyword_search(_documents(spark, d), _terms(spark, d), 20).select("query_id", "guid", _nine("text_rank"), "rank")


@query
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """The postings, summed up by term."""
    return search.postings(_documents(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences"))


@query
def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """The same search on postings, which carry the owner, within one language."""
    index = search.postings(_documents(spark, d), "language")
    return search.keyword_search(None, _terms(spark, d), 20, language="en", index=index).select("query_id", "guid", _nine("text_rank"), "rank")


@query
def keyword_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same search on stored postings by blocks, most of which are skipped."""
    folder = keywords.new_postings(_documents(spark, d))
    return keywords.stored_search(spark, folder, _terms(spark, d), 20).select("query_id", "guid", _nine("text_rank"), "rank")


@query
def keyword_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text's words as a phrase, a required word, an excluded one, and two alternatives."""
    w = F.filter(F.split(F.replace("text", F.lit('"'), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    text = F.concat(F.lit('"'), at(0), F.lit(" "), at(1), F.lit('" '), at(3), F.lit(" -"), at(8), F.lit(" or "), at(4), F.lit(" "), at(5), F.lit(" OR "), at(2), F.lit(' "'), at(6), F.lit(" "), at(7), F.lit('"'))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))
    return keywords.phrase_search(_documents(spark, d), q, 20).select("query_id", "guid", _nine("text_rank"), "rank")


@query
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search: the vector of a question's number stands for its embedding; documents without a vector are found by words alone."""
    docs = _documents(spark, d)
    chunks = docs.join(_vectors(spark, d).select("guid", "embedding"), "guid", "left")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    v = _vectors(spark, d)
    q = items.join(v, items.query_id == v.guid).select("query_id", F.col("embedding").alias("vector"))
    out = search.hybrid_search(chunks, q, _terms(spark, d), 20, 20, 20, texts=docs)
    return out.select("query_id", "guid", _nine("rrf_score"), "dense_rank", "keyword_rank", "rank")


@query
def hybrid_pools(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search's best five, from pools of the size that it chooses itself."""
    docs = _documents(spark, d)
    chunks = docs.join(_vectors(spark, d).select("guid", "embedding"), "guid", "left")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    v = _vectors(spark, d)
    q = items.join(v, items.query_id == v.guid).select("query_id", F.col("embedding").alias("vector"))
    return search.hybrid_search(chunks, q, _terms(spark, d), 5, texts=docs).select("query_id", "guid", _nine("rrf_score"), "dense_rank", "keyword_rank", "rank")


@query
def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Four sub-questions to a question, searched in one batch and fused."""
    found = search.keyword_search(_documents(spark, d), _terms(spark, d), 20)
    results = found.select(F.floor(F.col("query_id") / 4).alias("question_id"), F.col("query_id").alias("sub"), "guid", "rank")
    return search.multi_query(results, 20).select("query_id", "guid", _nine("rrf_score"), "n_lists", "rank")


def _candidates(spark, d, k=20):
    docs = _documents(spark, d)
    found = search.keyword_search(docs, _terms(spark, d), k)
    return found.join(docs.select("guid", "owner", "text"), "guid").withColumn("parent", F.col("guid") - F.col("guid") % 4)


@query
def expand_parents(spark: SparkSession, d: str) -> DataFrame:
    """Candidates to their pages: four neighbouring documents share one."""
    out = search.expand_to_pages(_candidates(spark, d), _documents(spark, d), 6000)
    return out.select("query_id", "guid", "parent_guid", F.size("matched_children").alias("n_children"), "expanded_from_parent", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "rank")


@query
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates reranked by the share of the question's words they have."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = _candidates(spark, d).join(q, "query_id")
    return search.rerank(rows, search.overlap_score(F.col("question"), F.col("text")), 10).select("query_id", "guid", _nine("rerank_score"), "retrieval_rank", "rank")


@query
def manual_override(spark: SparkSession, d: str) -> DataFrame:
    """Some candidates' ranks set by hand; scores and distances are mixed as they are."""
    v, q = _batch(spark, d)
    found = search.dense_search(v, q, 20).select("query_id", "guid", "cosine_distance", "rank")
    by_hand = v.filter("guid % 9 = 0").select("guid", (F.col("owner") / 4).alias("manual_rank_score"), F.lit("by hand").alias("manual_rank_reason"))
    return search.override(found, by_hand).select("query_id", "guid", _nine("cosine_distance"), "manual_rank_score", "rank")


@query
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered excerpts of each question's five best documents."""
    rows = _candidates(spark, d, 5).withColumnRenamed("owner", "source_key")
    return search.context_block(rows).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


# ---------------------------------------------------------------- text


@query
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("guid", T.detect_language(F.col("text")).alias("detected"))


@query
def grounding_words(spark: SparkSession, d: str) -> DataFrame:
    """What each document, as an answer, shares with the benchmark text that its number falls to."""
    b = table(spark, d, "benchmark")
    n = b.agg(F.max("item_id") + 1).first()[0]
    excerpts = b.select(F.col("item_id").alias("item"), F.col("text").alias("excerpt"))
    docs = _documents(spark, d).withColumn("item", F.col("guid") % n)
    return docs.join(excerpts, "item", "left").select("guid", F.array_join(T.grounding_words(F.col("text"), F.coalesce("excerpt", F.lit(""))), " ").alias("words"))


@query
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, titles, truncation and the heading test of all pages and documents, side by side where they share a number."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), T.slug(F.col("url")).alias("slug"), F.md5(T.clean_title(F.col("html"), "<>/")).alias("title_md5"))
    docs = table(spark, d, "documents")
    cut = docs.select(F.col("doc_id").alias("id"), F.length(T.truncate(F.col("text"), 1000)).alias("cut_chars"), T.looks_like_heading(F.col("text")).alias("heading"))
    return pages.join(cut, "id", "full_outer")


@query
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and cleaned titles of all pages, each title the whole text."""
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.md5(T.clean_title(F.col("html"), "<>/")).alias("title_md5"))


@query
def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    """Truncation of all documents."""
    return table(spark, d, "documents").select("doc_id", F.length(T.truncate(F.col("text"), 1000)).alias("cut_chars"))


@query
def qa_markup_check(spark: SparkSession, d: str) -> DataFrame:
    """Marks of a source and of a translation that lost some."""
    src = F.replace(F.replace("html", F.lit("<p>"), F.lit("[[")), F.lit("</p>"), F.lit("]]"))
    out = F.when(F.col("page_id") % 3 == 0, F.replace(src, F.lit("]]"), F.lit(""))).otherwise(src)
    return table(spark, d, "pages").select("page_id", T.markup_check(src, out).alias("qa")).select("page_id", "qa.marks_ok", "qa.sup_ok", F.col("qa.len_ratio").alias("len_ratio"))


@query
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of sources and pages."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ids.source_id(F.col("source"), F.col("lang")).alias("source_guid"), ids.page_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("page_guid"))


@query
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    """Comparable keys of all documents (Arrow: Spark has no compatibility decomposition)."""
    return _documents(spark, d).select("guid", F.md5(unicode.fold_column(F.col("text"))).alias("folded_md5"))


@query
def romanize(spark: SparkSession, d: str) -> DataFrame:
    """Devanagari runs to Latin letters; other texts are unchanged."""
    t = F.concat(F.col("text"), F.lit(" अहिंसा"))
    return table(spark, d, "benchmark").select("item_id", F.md5(unicode.romanize_column(t)).alias("romanized_md5"))


# ---------------------------------------------------------------- chunks and structure


@query
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines packed to 500 words."""
    docs = _documents(spark, d)
    packed = chunking.pack_blocks(F.split("text", "\n"))
    return docs.select("guid", F.posexplode(packed).alias("ord", "chunk")).select("guid", "ord", F.md5("chunk").alias("chunk_md5"), chunking.whitespace_tokens(F.col("chunk")).alias("tokens"))


def _headings(spark, d):
    h = html_headings(table(spark, d, "pages"))
    return h.select(F.col("page_id").alias("doc"), "idx", "level", "title", (F.col("idx") * 2).alias("start"))


def _with_pages(h):
    return h.join(h.groupBy("doc").agg((F.max("start") + 3).alias("n_pages")), "doc")


@query
def outline_ends(spark: SparkSession, d: str) -> DataFrame:
    return structure.next_ends(_with_pages(_headings(spark, d)), F.col("n_pages")).select("doc", "idx", "start", "end_page")


@query
def level_ends(spark: SparkSession, d: str) -> DataFrame:
    return structure.level_ends(_with_pages(_headings(spark, d)), F.col("n_pages")).select("doc", "idx", "level", "start", "end_page")


@query
def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by level and title, ends found before entries are dropped."""
    e = structure.outline_sections(_with_pages(_headings(spark, d)), F.col("n_pages"), levels=(1, 2), keep=((None, ".*[a-m].*"),), drop=("A.*",))
    return e.select("doc", "idx", "level", "title", "start", "end_page")


@query
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    """In how many pages each heading stands."""
    return structure.title_spread(_headings(spark, d).select(F.lit(0).alias("doc"), F.col("doc").alias("page"), "title")).select("title", F.col("on_pages").alias("pages"), "times")


@query
def heading_mode(spark: SparkSession, d: str) -> DataFrame:
    """Each page's heading level with most characters, the first seen of equals."""
    lines = _headings(spark, d).select("doc", F.lit(0).alias("page"), F.col("idx").alias("line"), F.col("level").alias("size"), F.col("title").alias("text"))
    return structure.body_sizes(lines).select("doc", F.col("body").alias("mode"))


@query
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Days with events of each user, as ranges."""
    days = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.datediff("ts", F.lit("2020-01-01")).alias("page")).distinct()
    return structure.page_ranges(days)


def _blocks(spark, d):
    c = table(spark, d, "conversations")
    bid = lambda t: F.concat_ws("_", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select(
        F.col("conv_id").cast("string").alias("source_key"), F.lit("en").alias("language"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("reading_order"), bid(F.col("turn")).alias("id"),
        F.when(F.col("role") == "system", "running_header").when(F.col("role") == "user", "heading").otherwise("paragraph").alias("type"),
        F.when(F.col("role") == "assistant", bid(F.col("turn") - 1)).when(F.col("turn") % 5 == 4, bid(F.col("turn") - 1)).otherwise("").alias("parent_block_id"), (F.col("role") == "assistant").alias("continues_from_previous_page"),
    )


@query
def link_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks: numbers, parents, levels, neighbours, continuations."""
    out = structure.link_blocks(_blocks(spark, d))
    return out.select("id", "number", "parent_id", "parent_number", "level", "prev_id", "next_id", "continues_from", F.array_join("child_ids", ",").alias("child_ids"), "is_translation_unit")


@query
def reading_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each turn begins in its conversation's text."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return structure.reading_offsets(rows, ["conv_id"], "turn").select("conv_id", "turn", "char_start")


def _lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", F.size(F.split("text", "\n")).alias("n_lines"), chunking.whitespace_tokens(F.col("text")).alias("n_words"))


@query
def book_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).select(F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page"), F.col("n_lines").alias("n_blocks"), "n_words")
    return structure.book_index(rows)


@query
def window_sections(spark: SparkSession, d: str) -> DataFrame:
    return structure.window_sections(_lines(spark, d).select(F.col("doc_id").alias("doc"), F.col("n_lines").alias("n_pages")))


@query
def split_oversized(spark: SparkSession, d: str) -> DataFrame:
    s = _lines(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.lit(1).alias("level"), F.lit(0).alias("start_page"), (F.col("n_words") - 1).alias("end_page")).filter("end_page >= 0")
    return structure.split_oversized(s)


@query
def fallback_sections(spark: SparkSession, d: str) -> DataFrame:
    """Outline, headings or windows: documents as books, their lines as pages; every third has an outline, every third headings."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "title"))
    docs = _lines(spark, d).select(F.col("doc_id").alias("doc"), F.col("n_lines").alias("n_pages"))
    entries = lines.filter("doc % 3 = 0").select("doc", "idx", (F.col("idx") % 3 + 1).alias("level"), F.md5("title").alias("title"), F.col("idx").alias("start"))
    headings = lines.filter("doc % 3 = 1 AND idx > 0").select("doc", F.col("idx").alias("page"), F.md5("title").alias("title"))
    return structure.fallback_sections(entries, headings, docs)


# ---------------------------------------------------------------- synchronisation and catalog


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    stored = docs.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("guid"), F.col("source").alias("owner"), F.md5("text").alias("digest"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    wanted = docs.filter("doc_id % 11 <> 5").select(F.col("doc_id").alias("guid"), F.col("source").alias("owner"), changed.alias("digest"))
    return stored, wanted


@query
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """What makes a stored snapshot equal to another: both are made from all documents."""
    return sync.actions(*_snapshots(spark, d), "guid", "digest")


@query
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    stored, wanted = _snapshots(spark, d)
    return sync.upsert(stored, wanted, "guid")


@query
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    stored, wanted = _snapshots(spark, d)
    return sync.insert_absent(stored, wanted, "guid")


@query
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("source_key"), F.col("lang").alias("language"), F.col("doc_id").alias("page"))
    totals = docs.filter("language = 'en'").groupBy("source_key", "language").agg((F.max("page") + 1).alias("total_pages"))
    return sync.source_summary(docs, totals)


def _targets(spark, docs):
    books = docs.select(F.col("source").alias("source_key"), F.col("lang").alias("language")).distinct()
    return sync.translation_targets(books, spark.createDataFrame([("fr", 1), ("en", 2), ("de", 3), ("es", 4), ("ru", 5)], "language string, ord int"))


@query
def translation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Languages that each source's documents lack, and the language they are translated from."""
    return _targets(spark, table(spark, d, "documents"))


@query
def catalog_attributes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.attributes(spark)


@query
def catalog_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return catalog.definitions(spark).select("code", "label", "parent", "parent_label", "ord")


@query
def integrity_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rules that documents, as pages of their sources, break: none, but for chunks whose page isn't there."""
    docs = table(spark, d, "documents")
    sources = docs.select(F.col("source").alias("guid"), F.col("source").alias("owner"), F.col("source").alias("source_key"), F.lit("en").alias("language")).distinct()
    pages = docs.filter("doc_id % 13 <> 1").select(F.col("doc_id").alias("guid"), F.col("source").alias("owner"), F.col("doc_id").alias("page"))
    chunks = docs.select(F.col("doc_id").alias("guid"), F.col("doc_id").alias("parent"), F.lit(0).alias("ord"))
    return catalog.integrity_faults(sources, pages, chunks)


# ---------------------------------------------------------------- geometry


def _word_boxes(spark, d):
    """Benchmark texts as pages of words: ten to a line."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("ord", "text"))
    return words.select(
        F.lit("benchmark").alias("source_key"), F.lit("en").alias("language"), "page", F.col("ord").cast("long").alias("ord"), "text",
        ((F.col("ord") % 10) * 0.09 + 0.05).alias("x"), (F.floor(F.col("ord") / 10) * 0.03 + 0.05).alias("y"), F.lit(0.08).alias("w"), F.lit(0.02).alias("h"),
    )


@query
def align_words(spark: SparkSession, d: str) -> DataFrame:
    """Boxes snapped to a text layer that lies a little aside and lacks some words."""
    words = _word_boxes(spark, d)
    layer = words.filter("ord % 7 <> 3").withColumn("x", F.col("x") + 0.004)
    return layout.refine_pages(words, layer).select("page", "ord", "text", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "bbox_source")


@query
def box_owner(spark: SparkSession, d: str) -> DataFrame:
    """Which block holds a word: a range join within pages; the first of several wins."""
    words = _word_boxes(spark, d).select(F.col("page").alias("page_id"), F.col("ord").alias("word"), ((F.col("x") + F.col("w") / 2) * 600).alias("cx"), ((F.col("y") + F.col("h") / 2) * 800).alias("cy"))
    rects = words.groupBy("page_id").agg(F.max("cy").alias("bottom")).select("page_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("bottom") / 20).cast("int"))).alias("ord"))
    rects = rects.select("page_id", "ord", F.col("ord").alias("block"), F.lit(0.0).alias("x0"), (F.col("ord") * 20 + 30).cast("double").alias("y0"), F.lit(600.0).alias("x1"), (F.col("ord") * 20 + 65).cast("double").alias("y1"))
    return layout.owners(words, rects)


@query
def box_partition(spark: SparkSession, d: str) -> DataFrame:
    """Each page's fragments partitioned over a third as many targets."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spans = sorted((i * 0.1, i * 0.1 + 0.05 + len(t) / 200) for i, t in enumerate(pdf.sort_values("ord")["text"]))
        n = max(1, len(spans) // 3)
        width = spans[-1][1] / n
        runs = layout.partition([(k * width, (k + 1) * width) for k in range(n)], spans) or []
        return pd.DataFrame({"page": key[0], "k": range(len(runs)), "first": [r[0] for r in runs], "n": [len(r) for r in runs]})

    return _word_boxes(spark, d).groupBy("page").applyInPandas(run, "page long, k long, first long, n long")
