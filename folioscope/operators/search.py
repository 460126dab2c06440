"""Search over chunks: dense, keyword, fusion, hybrid, many questions at once, reranking, overrides, page expansion.

Every result has an explicit ``rank`` from 1, and every order ends in ``guid``: no result depends on row order.
Chunks: ``guid, owner, language, parent, text, embedding array<float or double>`` (what an operator doesn't use may be
absent).  Queries: ``query_id, text`` and, for dense search, ``vector``.  Only batches of vectors whose size is known are
sent to all tasks; all else is left to joins, whose strategy Spark chooses by size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexemes as L
from ..functions import text as T
from ..plans.session import written
from . import dense
from .dense import MAX_ROWS

RRF_K = 60
MAX_QUERIES = 10_000  # terms that filter words before they move
PAIRS = 1 << 21  # pairs of texts and questions that a task counts, about
SENT = 1 << 18  # words or terms of questions that go to all tasks


def pool(n: int) -> int:
    """Candidates to fetch where ``n`` rows are wanted in the end."""
    return max(4 * n, 15)


def cosine_distance(a: Column, b: Column) -> Column:
    """In double precision, summed from left to right."""
    d = lambda v: v.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.lit(1.0) - dot(d(a), d(b)) / F.sqrt(dot(d(a), d(a)) * dot(d(b), d(b)))


def scoped(chunks: DataFrame, owner=None, language: str | None = None) -> DataFrame:
    """Filters only where one is set, so that they reach the scan."""
    if owner is not None:
        chunks = chunks.filter(F.col("owner") == owner)
    if language is not None:
        chunks = chunks.filter(F.col("language") == language)
    return chunks


def top_per_query(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``min(k, MAX_ROWS)`` rows of each query, ranked."""
    w = Window.partitionBy("query_id").orderBy(*order, F.col("guid"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(k, MAX_ROWS))


def dense_search(chunks: DataFrame, queries: DataFrame, k: int = 5, owner=None, language: str | None = None) -> DataFrame:
    """``query_id, guid, cosine_distance, rank``: the nearest chunks by cosine, exact; equal distances stand by ``guid``.

    Chunks and queries without a sound vector, or of another length, take no part.  At most ``dense.SENT`` questions go to all
    tasks; more are dealt to blocks of chunks by key (see :func:`folioscope.operators.dense.nearest`).
    """
    cell = F.lit(0).alias("cell")
    return dense.nearest(scoped(chunks, owner, language).select(cell, "guid", "embedding"), queries.select(cell, "query_id", "vector"), min(k, MAX_ROWS))


def dense_search_one(chunks: DataFrame, vector: list[float], k: int = 5, owner=None, language: str | None = None) -> DataFrame:
    """As :func:`dense_search` for one vector: a top-k without a window."""
    c = scoped(chunks, owner, language).filter(F.col("embedding").isNotNull())
    q = F.array(*[F.lit(float(x)) for x in vector])
    best = c.select("guid", cosine_distance(F.col("embedding"), q).alias("cosine_distance")).orderBy("cosine_distance", "guid").limit(min(k, MAX_ROWS))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("cosine_distance", "guid")))  # MAX_ROWS rows at most


def or_query(question: str) -> str:
    """The question's words, without marks at their ends, as alternatives; a question without words stays as it is."""
    words = [w for w in (x.strip(string.punctuation) for x in question.split()) if w]
    return " OR ".join(words) or question


def or_queries(question: Column) -> Column:
    """:func:`or_query` of a column."""
    words = F.filter(F.transform(F.split(question, "(?U)\\s+"), lambda w: F.btrim(w, F.lit(string.punctuation))), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(words, " OR ")).otherwise(question)


def terms_of(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the distinct terms of each question; one of stop words alone has none. The operator of an or-query is a stop word."""
    words = queries.select("query_id", F.explode(L.tokens(F.col("text"))).alias("word")).filter(~F.col("word").isin(*L.STOP)).distinct()
    return L.stemmed(words).select("query_id", "term").distinct()


def postings(chunks: DataFrame, *carry: str) -> DataFrame:
    """``term, guid, tf`` and the chunks' columns ``carry``: an inverted index. Written bucketed by term, it serves many searches."""
    return L.lexemes(chunks, *carry).select("term", "guid", "tf", *carry)


def sent_rows(rows: DataFrame) -> DataFrame | None:
    """Words or terms of questions, to go to all tasks: None if they are more than ``SENT``."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else None


def by_text(texts: DataFrame, asked: DataFrame, each: int = 1) -> DataFrame:
    """``texts`` dealt by ``guid``, so finely that a task has about ``PAIRS`` pairs of texts and questions (``each``: rows of a pair), however many partitions the session has."""
    few = -(-texts.count() * asked.select("query_id").distinct().count() * each // PAIRS)
    return texts.repartition(few, "guid") if few > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else texts.repartition("guid")


def keyword_search(chunks: DataFrame | None, terms: DataFrame, k: int = 5, owner=None, language: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """``query_id, guid, text_rank, rank``: a tenth for each occurrence of a term, which is the cover density of alternatives.

    ``terms``: ``query_id, term``, as :func:`terms_of` gives them.  ``index``: postings to read instead of texts, with
    ``owner`` and ``language`` where these are asked for.  Texts are dealt by ``guid`` and counted there, so that neither words
    nor counts move, only each task's best; where the questions have too many words for that, words that may be terms move.
    """
    asked = written(terms.select("query_id", "term"), "asked")
    if index is None:
        texts = scoped(chunks, owner, language).select("guid", "text")
        known = [r[0] for r in asked.select("term").distinct().limit(MAX_QUERIES + 1).collect()]
        may = L.may_have(known) if len(known) <= MAX_QUERIES else F.lit(True)
        names = written(L.vocabulary(L.occurrences(texts).filter(may)).join(asked, "term").select("query_id", "word"), "names")
        if (sent := sent_rows(names)) is not None:
            counted = L.occurrences(by_text(texts, asked)).join(sent, "word").groupBy("guid", "query_id").agg(F.count(F.lit(1)).alias("n"))
        else:
            counted = L.words(texts, may).join(names, "word").groupBy("guid", "query_id").agg(F.sum("n").alias("n"))
    else:
        sent = sent_rows(asked)
        counted = scoped(index, owner, language).join(asked if sent is None else sent, "term").groupBy("guid", "query_id").agg(F.sum("tf").alias("n"))
    return top_per_query(counted.select("query_id", "guid", (F.lit(0.1) * F.col("n")).alias("text_rank")), k, F.desc("text_rank"))


def rrf(lists: dict[str, DataFrame], k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``query_id, guid, rank``): a union and one aggregation, not outer joins.

    ``rrf_score`` adds 1 / (k + rank); ``<name>_rank`` is the row's rank in a list, or null.  Equal scores stand in the
    order in which lists, then ranks, showed them first.
    """
    union = None
    for i, (name, df) in enumerate(lists.items()):
        part = df.select("query_id", "guid", F.col("rank").cast("int").alias("r"), F.lit(i).alias("list"), F.lit(name).alias("name"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "guid").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("list", "r"))), F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(k) + x["r"])).alias("rrf_score"),  # one row a list, added in their order
        *[F.max(F.when(F.col("name") == name, F.col("r"))).alias(f"{name}_rank") for name in lists],
        F.min(F.struct("list", "r")).alias("first"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first.list", "first.r", "guid")
    ranked = fused.withColumn("rank", F.row_number().over(w)).drop("first")
    return ranked.filter(F.col("rank") <= top) if top else ranked


def hybrid_search(chunks: DataFrame, queries: DataFrame, terms: DataFrame, n: int = 5, dense_pool: int | None = None, keyword_pool: int | None = None, k: int = RRF_K, owner=None, language=None, index: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Dense and keyword search, fused; pools of 0 mean the default. ``index``: postings for the keyword side; ``texts``: the chunks as they are before vectors are joined to them, so that texts needn't move in that join."""
    dense = dense_search(chunks, queries, dense_pool or pool(n), owner, language)
    keyword = keyword_search(chunks if texts is None else texts, terms, keyword_pool or pool(n), owner, language, index)
    return rrf({"dense": dense, "keyword": keyword}, k, n)


def multi_query(results: DataFrame, n: int = 5, k: int = RRF_K) -> DataFrame:
    """One fused list of each question's sub-questions. ``results``: ``question_id, sub, guid, rank`` from one batched search."""
    fused = results.groupBy(F.col("question_id").alias("query_id"), "guid").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("sub", "rank"))), F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(k) + x["rank"])).alias("rrf_score"),
        F.min(F.struct("sub", "rank")).alias("first"),
        F.count(F.lit(1)).alias("n_lists"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first.sub", "first.rank", "guid")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first").filter(F.col("rank") <= n)


def rerank(candidates: DataFrame, score: Column, top: int | None = None) -> DataFrame:
    """Adds ``rerank_score`` and ``retrieval_rank`` (the rank so far), and ranks anew."""
    scored = candidates.withColumn("retrieval_rank", F.col("rank")).withColumn("rerank_score", score.cast("double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retrieval_rank")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top) if top else out


def overlap_score(question: Column, text: Column) -> Column:
    """An offline reranker: the share of the question's words that the text has."""
    q = F.array_distinct(T.words_of(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words_of(text))) / F.size(q)).otherwise(F.lit(0.0))


def override(candidates: DataFrame, overrides: DataFrame, resort: bool = True) -> DataFrame:
    """Manual ranks: ``overrides`` has ``guid, manual_rank_score, manual_rank_reason``; of several for one chunk the highest holds.

    Order: by manual score, else rerank score, both downwards, else distance; kept as it is, scales mixed; ties by rank.
    """
    one = overrides.groupBy("guid").agg(F.max(F.struct("manual_rank_score", "manual_rank_reason")).alias("m")).select("guid", "m.manual_rank_score", "m.manual_rank_reason")
    joined = candidates.join(one, "guid", "left")
    if not resort:
        return joined
    has = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("double")
    key = F.coalesce(-F.col("manual_rank_score"), -has("rerank_score"), has("cosine_distance"), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(key, "rank")
    return joined.withColumn("new_rank", F.row_number().over(w)).drop("rank").withColumnRenamed("new_rank", "rank")


def check_known(candidates: DataFrame, guid) -> None:
    if candidates.filter(F.col("guid") == guid).isEmpty():
        raise ValueError(f"no chunk {guid!r} in the list: an override reorders what was retrieved")


def expand_to_pages(candidates: DataFrame, pages: DataFrame, most: int | None = 6000) -> DataFrame:
    """Chunks to their pages: one row for each parent, in order of its best chunk, with the page's text cut at ``most``.

    ``candidates``: ``query_id, guid, parent, rank, text``; ``pages``: ``guid, text``.  A missing page leaves the chunk; so
    does a missing parent, and each such chunk stands for itself.
    """
    alone = F.when(F.col("parent").isNull(), F.col("guid"))
    grouped = candidates.groupBy("query_id", "parent", alone.alias("alone")).agg(
        F.min_by("guid", "rank").alias("guid"), F.min_by("text", "rank").alias("chunk_text"), F.min("rank").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "guid"))), lambda x: x["guid"]).alias("matched_children")
    )
    page = pages.select(F.col("guid").alias("parent"), F.col("guid").alias("parent_guid"), F.col("text").alias("page_text"))
    joined = page.join(grouped, "parent", "right")
    w = Window.partitionBy("query_id").orderBy("best", "parent", "guid")
    found = F.col("parent_guid").isNotNull()
    return joined.select(
        "query_id", "guid", "parent_guid", "matched_children", found.alias("expanded_from_parent"), F.when(found, T.truncate(F.col("page_text"), most)).otherwise(F.col("chunk_text")).alias("text"), F.row_number().over(w).alias("rank")
    )


def context_block(rows: DataFrame) -> DataFrame:
    """``query_id, context``: numbered excerpts in order of rank. Rows: ``query_id, rank, source_key, text`` and maybe ``rerank_score``, ``title``, ``matched_children``."""
    label = F.format_string("[Excerpt %d -- %s", F.col("rank").cast("int"), F.col("source_key"))
    if "title" in rows.columns:
        label = F.concat(label, F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" | "), "title")).otherwise(""))
    if "matched_children" in rows.columns:
        n = F.size("matched_children")
        label = F.concat(label, F.when(F.col("expanded_from_parent"), F.concat(F.lit(" | expanded from "), n.cast("string"), F.when(n == 1, " matched chunk").otherwise(" matched chunks"))).otherwise(""))
    if "rerank_score" in rows.columns:
        label = F.concat(label, F.coalesce(F.format_string(" | relevance %.2f", "rerank_score"), F.lit("")))
    part = F.concat(label, F.lit("]\n"), F.col("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
