"""Reads of stored tables: payload fields, rows by id, lists of sources, pages, owners; and overrides that are kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def payload_columns(rows: DataFrame, payload: str, fields: Mapping[str, str]) -> DataFrame:
    """Typed columns from a JSON payload: ``name`` to ``type``. What isn't there, or can't be read as its type, is null; a boolean, false."""
    parsed = F.try_parse_json(F.col(payload))
    read = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
    return rows.select("*", *[(F.coalesce(read(n, k), F.lit(False)) if k == "boolean" else read(n, k)).alias(n) for n, k in fields.items()])


def merge_payload(payload: Column, changes: Column) -> Column:
    """A JSON object with the keys of another in place of its own, both as text; a payload that is no object gives the changes."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    mine, new = as_map(payload), as_map(changes)
    return F.to_json(F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(new, k)), new))


def keep_override(stored: DataFrame, guid, score: float, reason: str, payload: str = "payload") -> DataFrame:
    """The stored rows with a manual rank in the payload of one. An unknown id is an error."""
    if stored.filter(F.col("guid") == F.lit(guid)).isEmpty():
        raise ValueError(f"no row {guid!r}")
    changes = F.to_json(F.struct(F.lit(float(score)).alias("manual_rank_score"), F.lit(reason).alias("manual_rank_reason")))
    return stored.withColumn(payload, F.when(F.col("guid") == F.lit(guid), merge_payload(F.col(payload), changes)).otherwise(F.col(payload)))


def select_rows(rows: DataFrame, equal: Mapping[str, object], *order: str) -> DataFrame:
    """Rows that agree with all of ``equal``, in order. Conditions are plain, so they reach the scan."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows.orderBy(*order) if order else rows


def row_by_id(rows: DataFrame, guid) -> Row | None:
    """One row, or None."""
    return next(iter(rows.filter(F.col("guid") == F.lit(guid)).limit(1).collect()), None)


def rows_by_ids(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``guid`` to the rows with these ids, nulls where there are none: many lookups in one join."""
    return ids.join(rows, "guid", "left")


def sources_list(sources: DataFrame, language: str | None = None) -> DataFrame:
    """All sources, of one language if it is given, in the order of their list."""
    own = sources if language is None else sources.filter(F.col("language") == language)
    return own.select("guid", "source_key", "language", "title", "page_count", "recognised_pages", "first_page", "ord").orderBy("ord", "guid")


def page_of(pages: DataFrame, source_key: str, page: int = 1, language: str = "fr") -> Row:
    """A page's row; LookupError where there is none."""
    found = pages.filter((F.col("source_key") == source_key) & (F.col("language") == language) & (F.col("page_number") == page)).orderBy("guid").limit(1).collect()
    if not found:
        raise LookupError(f"no page {page} for {source_key} [{language}]")
    return found[0]


def owners_of(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_key, language`` (null: any) to ``guid``: the first source by language, null where there is none."""
    match = (F.col("w.source_key") == F.col("s.source_key")) & (F.col("w.language").isNull() | (F.col("w.language") == F.col("s.language")))
    found = wanted.alias("w").join(sources.alias("s"), match, "left")
    return found.groupBy(F.col("w.source_key").alias("source_key"), F.col("w.language").alias("language")).agg(F.min_by("s.guid", F.struct("s.language", "s.guid")).alias("guid"))


def owner_of(sources: DataFrame, source_key: str, language: str | None = None):
    """The id of a source, of its first language if none is asked for; LookupError where there is none."""
    own = sources.filter(F.col("source_key") == source_key)
    own = own if language is None else own.filter(F.col("language") == language)
    found = own.orderBy("language", "guid").select("guid").limit(1).collect()
    if not found:
        raise LookupError(f"no source {source_key}" + (f" [{language}]" if language else ""))
    return found[0][0]


def page_numbers(own: Column, expanded: Column | None = None) -> Column:
    """The pages behind a row, none or one: of the page it was expanded to, if there is one, else its own."""
    page = own if expanded is None else F.coalesce(expanded, own)
    return F.when(page.isNull(), F.array().cast("array<int>")).otherwise(F.array(page.cast("int")))


def teardown(spark, names: Sequence[str]) -> list[str]:
    """Drops tables; gives the names that are still there, none if all is well."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return [n for n in names if spark.catalog.tableExists(n)]
