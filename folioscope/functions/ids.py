"""Deterministic row ids: name-based UUIDs (version 5) as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ids of sources, pages and chunks must equal those already stored.
NAMESPACE = "6f1c2d9e-3b7a-4c55-9d0e-1a2b3c4d5e6f"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122: SHA-1 of namespace and name, with version and variant set."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    variant = F.substring(F.lit("89ab"), nibble + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def source_id(key: Column, language: Column) -> Column:
    return uuid5(F.concat(F.lit("source:"), key, F.lit(":"), language))


def page_id(key: Column, language: Column, page: Column) -> Column:
    return uuid5(F.concat(F.lit("page:"), key, F.lit(":"), language, F.lit(":"), page.cast("string")))


def chunk_id(page_guid: Column, index: Column) -> Column:
    return uuid5(F.concat(F.lit("chunk:"), page_guid, F.lit(":"), index.cast("string")))
