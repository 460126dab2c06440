"""Stored tables kept equal to what is on disk: actions, new snapshots, and what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions(stored: DataFrame, wanted: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, action``: insert, update or delete; rows that agree have none. One full outer join."""
    s, w = stored.select(key, F.col(digest).alias("_s")), wanted.select(key, F.col(digest).alias("_w"))
    both = s.withColumn("_in_s", F.lit(True)).join(w.withColumn("_in_w", F.lit(True)), key, "full_outer")
    action = F.when(F.col("_in_s").isNull(), "insert").when(F.col("_in_w").isNull(), "delete").when(~F.col("_s").eqNullSafe(F.col("_w")), "update")
    return both.select(key, action.alias("action")).filter("action IS NOT NULL")


def _one_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with one key the last by ``order``, then by content: the same whatever order they come in."""
    columns = [*order, *[c for c in rows.columns if c != key and c not in order]]
    if not columns:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("r")).select(*[F.col(f"`{key}`") if c == key else F.col("r")[c].alias(c) for c in rows.columns])


def upsert(stored: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The stored rows with ``rows`` in place of those of the same key, or added. Write it as a new snapshot.

    Of several new rows with one key the last by ``order`` holds; equal there, the greatest by content.
    """
    new = _one_per_key(rows, key, *order)
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(stored: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows whose key isn't stored yet, to append; of several with one key the last by ``order``, then by content."""
    return _one_per_key(rows, key, *order).join(stored.select(key), key, "left_anti")


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def cascade(stale_sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and chunks that stay when sources go (``guid`` of the sources; ``owner`` of the others)."""
    gone = stale_sources.select(F.col("guid").alias("owner"))
    return pages.join(gone, "owner", "left_anti"), chunks.join(gone, "owner", "left_anti")


def source_summary(pages: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A row for each source: recognised pages, the first page, and the book's page count where it is known."""
    out = pages.groupBy("source_key", "language").agg(F.count(F.lit(1)).alias("recognised_pages"), F.min("page").alias("first_page"))
    if totals is None:
        return out.withColumn("page_count", F.col("recognised_pages"))
    return out.join(totals.select("source_key", "language", F.col("total_pages")), ["source_key", "language"], "left").withColumn("page_count", F.coalesce("total_pages", "recognised_pages")).drop("total_pages")


def translated_index(pages: DataFrame) -> DataFrame:
    """``source_key, language, page, blocks array<struct<words, layout struct<scale>>>``: blocks, words, and the least scale (1 where none is given)."""
    scale = F.array_min(F.transform("blocks", lambda b: F.coalesce(b["layout"]["scale"], F.lit(1.0))))
    words = F.aggregate("blocks", F.lit(0), lambda s, b: s + F.size(b["words"]))
    return pages.select("source_key", "language", "page", F.size("blocks").alias("blocks"), words.alias("words"), F.coalesce(scale, F.lit(1.0)).alias("min_scale"))


def book_status(sources: DataFrame, pages: DataFrame, chunks: DataFrame, pattern: str, expected: int | None = None) -> DataFrame:
    """The first source (by key and language) whose key is like ``pattern``, its counts, and whether it is complete and ready."""
    found = sources.filter(F.col("source_key").ilike(pattern)).orderBy("source_key", "language").limit(1)
    count = lambda df, name: df.groupBy("owner").agg(F.count(F.lit(1)).alias(name))
    out = found.join(count(pages, "pages"), found.guid == F.col("owner"), "left").drop("owner").join(count(chunks, "chunks"), found.guid == F.col("owner"), "left").drop("owner")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    want = F.col("page_count") if expected is None else F.lit(expected)
    complete = F.coalesce(want.isNotNull() & (n("pages") >= want), F.lit(False))
    return out.withColumn("pages", n("pages")).withColumn("chunks", n("chunks")).withColumn("complete", complete).withColumn("ready", complete & (F.col("chunks") > 0))


def first_per_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key, by a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def translation_targets(pdfs: DataFrame, languages: DataFrame) -> DataFrame:
    """``source_key, language`` of books on disk, and ``language, ord``: the languages each book lacks, and the language it is translated from.

    One pass over the books: each one's known languages against the list, which is a row for each language asked for.
    """
    wanted = [r["language"] for r in languages.orderBy("ord", "language").collect()]
    order = F.create_map(*[x for i, v in enumerate(wanted) for x in (F.lit(v), F.lit(i))]) if wanted else F.create_map().cast("map<string,int>")
    has = pdfs.filter(F.col("language").isin(*wanted)).groupBy("source_key").agg(F.collect_set("language").alias("has"), F.min_by("language", order[F.col("language")]).alias("source_language"))
    lacks = F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), "has")
    return has.select("source_key", F.explode(lacks).alias("language"), "source_language")
