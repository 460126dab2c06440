"""Keyword queries with phrases, required and excluded words, ranked by cover density; and stored postings with early stop.

A query is written as on the web: words are all required, ``"words in quotes"`` stand side by side, ``-word`` and ``-"a phrase"``
are excluded, and ``or`` parts alternatives.  A word of several terms (``g/kg``) is a phrase.  Stop words are left out, but
keep their places within a phrase.

The rank is cover density: a cover is a stretch that holds one alternative's words, no shorter one within it; it counts a
tenth, divided by one more than the places in it that hold no word of the query.  Where the words are alternatives only,
this is a tenth for each occurrence.

Defined cases: a null text has no terms; an alternative of excluded words or stop words alone finds nothing; an alternative
whose excluded words a text has plays no part in its rank; texts that share a guid are one text (their positions overlap);
equal ranks stand by guid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexemes as L
from ..plans.session import scratch, written
from . import search

#: An item of a query: a phrase in quotes or a word, with a minus before it or not.
ITEM = '-?"[^"]*"|[^ \\t\\n\\x0B\\f\\r"]+'


def clauses(queries: DataFrame) -> DataFrame:
    """``query_id, text`` to ``query_id, grp, item, negated, off, term, n``: a row for each term of each item, ``n`` terms in the item."""
    items = queries.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(ITEM), F.lit(0))).alias("item", "raw"))
    parts = F.sum(F.when(F.lower("raw") == "or", 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("item"))
    grouped = items.withColumn("grp", parts).filter(F.lower("raw") != "or")
    each = grouped.select("query_id", F.col("grp").cast("int").alias("grp"), "item", F.col("raw").startswith("-").alias("negated"), F.posexplode(L.tokens(F.col("raw"))).alias("off", "word")).filter(~F.col("word").isin(*L.STOP))
    named = each.join(L.vocabulary(each), "word")
    return named.select("query_id", "grp", "item", "negated", "off", "term", F.count(F.lit(1)).over(Window.partitionBy("query_id", "item")).cast("int").alias("n"))


def positions(chunks: DataFrame, known: list[str] | None = None) -> DataFrame:
    """``guid, text`` to ``guid, term, pos``; ``known``: stems, where words that can't have one of them needn't move."""
    each = chunks.select("guid", F.posexplode(L.tokens(F.col("text"))).alias("pos", "word")).filter(~F.col("word").isin(*L.STOP))
    if known is not None:
        each = each.filter(L.may_have(known))
    each = written(each.repartition("word"), "words")
    return each.join(L.vocabulary(each), "word").select("guid", "term", "pos")


def phrase_search(chunks: DataFrame, queries: DataFrame, k: int = 5, owner=None, language: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """``query_id, guid, text_rank, rank``. ``index``: ``guid, term, pos`` as :func:`positions` gives it (and columns that the filters need), to read instead of texts."""
    asked = written(clauses(queries), "clauses")
    texts = names = None
    if index is None:
        texts = search.scoped(chunks, owner, language).select("guid", "text")
        known = [r[0] for r in asked.select("term").distinct().limit(search.MAX_QUERIES + 1).collect()]
        may = L.may_have(known) if len(known) <= search.MAX_QUERIES else F.lit(True)
        names = search.sent_rows(written(L.vocabulary(L.occurrences(texts).filter(may)).join(asked.select("term").distinct(), "term").select("word", "term"), "names"))
        if names is None:
            index = positions(texts, known if len(known) <= search.MAX_QUERIES else None)
        else:
            texts = search.by_text(texts, asked, 8)
    else:
        index = search.scoped(index, owner, language)
    sent = search.sent_rows(asked)
    sent = asked if sent is None else sent

    def met(of: DataFrame | None = None) -> DataFrame:
        """Where texts have terms of the items: all, or those of ``guid, whole``, with the number of items where their alternative is whole. A text's rows stay where its ``guid`` is dealt."""
        rows, more = (index if names is None else texts), [] if of is None else ["whole"]
        rows = rows if of is None else rows.join(of, "guid")
        if names is not None:
            rows = rows.select("guid", *more, F.posexplode(L.tokens(F.col("text"))).alias("pos", "word")).join(names, "word")
        rows = rows.select("guid", "term", "pos", *more).distinct().join(sent, "term")
        items = F.lit(0)
        if of is not None:
            rows = rows.filter(F.exists("whole", lambda x: x["query_id"] == F.col("query_id")))
            items = F.get(F.filter("whole", lambda x: (x["query_id"] == F.col("query_id")) & (x["grp"] == F.col("grp"))), F.lit(0))["items"]
        return rows.select("query_id", "guid", "grp", "item", "negated", "off", "n", "pos", items.alias("items"))

    def standing(hits: DataFrame) -> DataFrame:
        """An item stands where all its terms do, each at its place."""
        return hits.groupBy(*text, "grp", "item", "negated", "n", "items", (F.col("pos") - F.col("off")).alias("anchor")).agg(F.count(F.lit(1)).alias("have"), F.min("pos").alias("start"), F.max("pos").alias("end")).filter("have = n")

    text = ["query_id", "guid"]
    wanted = asked.groupBy("query_id", "grp").agg(F.count_distinct(F.when(~F.col("negated"), F.col("item"))).alias("items"))
    matched = standing(met()).groupBy(*text, "grp").agg(F.count_distinct(F.when(~F.col("negated"), F.col("item"))).alias("met"), F.max("negated").alias("spoilt"))
    matched = matched.join(F.broadcast(wanted) if sent is not asked else wanted, ["query_id", "grp"]).filter("NOT spoilt AND met = items")
    # then the places in texts that match a query, which are far fewer; what follows stays where a text is dealt
    whole = written(matched.groupBy("guid").agg(F.collect_set(F.struct("query_id", "grp", "items")).alias("whole")), "whole")
    hits = written(met(whole), "hits").repartition("guid")
    held = standing(hits).filter("NOT negated AND items IS NOT NULL")
    # for each end of an item the last start from which its alternative is whole: the least of its items' last starts
    single = held.filter("items = 1").select(*text, F.col("end").alias("e"), F.col("start").alias("s"))
    several = held.filter("items > 1").withColumn("wants", F.collect_set("item").over(Window.partitionBy(*text, "grp"))).withColumn("want", F.explode("wants")).drop("wants")
    so_far = Window.partitionBy(*text, "grp", "want").orderBy("end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = several.withColumn("last", F.max(F.when(F.col("item") == F.col("want"), F.col("start"))).over(so_far)).groupBy(*text, "grp", "end", "items").agg(F.min("last").alias("s"), F.count_distinct(F.when(F.col("last").isNotNull(), F.col("want"))).alias("met"))
    ends = single.unionByName(last.filter("met = items").select(*text, F.col("end").alias("e"), "s")).groupBy(*text, "e").agg(F.max("s").alias("s"))
    before = Window.partitionBy(*text).orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    covers = ends.withColumn("known", F.max("s").over(before)).filter("known IS NULL OR s > known").select(*text, "s", "e")
    places = hits.groupBy(*text).agg(F.array_sort(F.collect_set("pos")).alias("places"))
    inside = F.size(F.filter("places", lambda p: (p >= F.col("s")) & (p <= F.col("e"))))
    weighed = covers.join(places, text).withColumn("cover", F.lit(0.1) / (F.lit(1) + F.col("e") - F.col("s") - (inside - 1)))
    ranked = weighed.groupBy(*text).agg(F.aggregate(F.array_sort(F.collect_list("cover")), F.lit(0.0), lambda a, x: a + x).alias("text_rank"))
    return search.top_per_query(ranked, k, F.desc(F.round("text_rank", 12)))


# ---------------------------------------------------------------- stored postings

BUCKETS = 64  # of terms: folders of the stored postings
BLOCK = 4096  # texts of a block, about
FIRST = 4  # blocks that give a query its first results


def build_postings(chunks: DataFrame, folder: str) -> str:
    """Writes postings of ``guid, text`` (and ``owner``, ``language`` where there are some) by blocks of texts, and gives the folder back.

    Texts of like length share a block, so the greatest count of a term in a block says much about it.  A row is a term in a
    block: ``bucket, term, block, top, postings array<struct<guid, tf, ...>>``, stored by bucket and in order of term and block.
    """
    carried = [c for c in ("owner", "language") if c in chunks.columns]
    terms = F.collect_list(F.struct("term", "tf", *carried)).alias("terms")
    texts = L.lexemes(chunks, *carried).groupBy("guid").agg(terms, F.floor(F.lit(2.0) * F.log2(F.sum("tf"))).cast("long").alias("size"))
    texts = written(texts, "texts")  # a text's counts stay together until its block is known
    parts = texts.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # 2 log2 of a text's length: 128 rows at most
    block = ((F.col("size") + 1) * (1 << 40) + F.pmod(F.xxhash64("guid"), F.col("parts"))).alias("block")
    each = texts.join(F.broadcast(parts), "size").select("guid", block, F.explode("terms").alias("t")).select("guid", "block", "t.*")
    key = ["bucket", "term", "block"]  # dealt by ranges of it once, and grouped there
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).repartitionByRange(*key)
    stored = dealt.groupBy(*key).agg(F.max("tf").alias("top"), F.collect_list(F.struct("guid", "tf", *carried)).alias("postings")).select("term", "block", "top", "postings", "bucket")
    stored.limit(0).write.parquet(f"{folder}/schema")
    stored.sortWithinPartitions(*key).write.partitionBy("bucket").parquet(f"{folder}/postings")
    return folder


def stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/postings")


def new_postings(chunks: DataFrame) -> str:
    """Postings in the shared folder."""
    return build_postings(chunks, scratch(chunks.sparkSession, "postings"))


def stored_search(spark: SparkSession, folder: str, terms: DataFrame, k: int = 5, owner=None, language: str | None = None) -> DataFrame:
    """As :func:`search.keyword_search`, from stored postings, without reading a text or most postings.

    A query's bound in a block is the sum of its terms' greatest counts there.  The blocks with the greatest bounds are read
    first; then those whose bound reaches the last of the ``k`` ranks so found, since no other can hold a better text.
    """
    k, terms = min(k, search.MAX_ROWS), written(terms.select("query_id", "term"), "terms")
    bounds, first = _first_blocks(spark, folder, terms)
    scored = written(_scored(spark, folder, terms, first, owner, language), "scored")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"))
    last = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", F.col("n").alias("least"))
    rest = _other_blocks(bounds, first, last)
    both = scored.unionByName(_scored(spark, folder, terms, rest, owner, language)).select("query_id", "guid", (F.lit(0.1) * F.col("n")).alias("text_rank"))
    return search.top_per_query(both, k, F.desc("text_rank"))


def _asked(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", "term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _first_blocks(spark: SparkSession, folder: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, block, bound`` of all blocks with a term of the query, and of those with the greatest bounds."""
    heads = stored_postings(spark, folder).select("bucket", "term", "block", "top")
    bounds = written(heads.join(_asked(terms), ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum("top").alias("bound")), "bounds")
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    return bounds, bounds.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= FIRST).drop("r")


def _other_blocks(bounds: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """The blocks still to be read: those that may hold a text as good as the last found; all, where fewer than ``k`` were found."""
    left = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(last, "query_id", "left")
    return left.filter("least IS NULL OR bound >= least").select("query_id", "block")


def _scored(spark: SparkSession, folder: str, terms: DataFrame, blocks: DataFrame, owner, language: str | None) -> DataFrame:
    asked, wanted = _asked(terms), written(blocks.select("query_id", "block"), "wanted")
    sides = [(x if (sent := search.sent_rows(x)) is None else sent) for x in (asked, wanted)]  # so that stored postings don't move
    met = stored_postings(spark, folder).select("bucket", "term", "block", "postings").join(sides[0], ["bucket", "term"]).join(sides[1], ["query_id", "block"])
    each = met.select("query_id", F.explode("postings").alias("p"))
    for name, value in (("owner", owner), ("language", language)):
        if value is not None:
            each = each.filter(F.col(f"p.{name}") == value)
    return each.groupBy("query_id", F.col("p.guid").alias("guid")).agg(F.sum("p.tf").alias("n"))
