"""Sections from what a book prints about itself: its table of contents, chapter headings, answer sheets and appendices; and rules by source.

Pages count from 0: ``doc, page, text``.  Entries are ``doc, idx, title, start`` in order of ``idx``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import nfc
from . import structure

#: A title line, then a line with a number alone.
TOC_ENTRY = "(?m)^[ \\t]*(\\S[^\\n]*?)[ \\t]*\\n[ \\t]*(\\d{1,4})[ \\t]*$"


def last_of_page(entries: DataFrame) -> DataFrame:
    """Of entries, in order, that begin on one page, the last of each run."""
    after = F.lead("start").over(Window.partitionBy("doc").orderBy("idx"))
    return entries.withColumn("_after", after).filter("_after IS NULL OR _after <> start").drop("_after")


def first_per_chapter(pages: DataFrame, pattern: str) -> DataFrame:
    """``doc, number, start``: the first page on which each chapter number stands. ``pattern`` has the number as its group."""
    each = pages.select("doc", "page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("n"))
    return each.groupBy("doc", F.col("n").cast("int").alias("number")).agg(F.min("page").alias("start"))


def printed_contents(pages: DataFrame, marker: str = "Contents", least: int = 2) -> DataFrame:
    """``doc, idx, title, printed, first_body``: entries of a printed table of contents.

    It begins on the first page that begins with ``marker`` and goes on while pages have ``least`` entries; the page after it
    is the first of the body.  A document without one has no rows.
    """
    counted = pages.withColumn("found", F.size(F.regexp_extract_all("text", F.lit(TOC_ENTRY), F.lit(0))))
    begin = counted.filter(F.ltrim(F.col("text")).startswith(marker)).groupBy("doc").agg(F.min("page").alias("begin"))
    after = counted.join(begin, "doc").filter("page > begin")
    end = after.groupBy("doc", "begin").agg(F.min(F.when(F.col("found") < least, F.col("page"))).alias("stop"), F.max("page").alias("last"))
    span = begin.join(end.drop("begin"), "doc", "left").select("doc", "begin", F.coalesce("stop", F.col("last") + 1, F.col("begin") + 1).alias("first_body"))
    listed = pages.join(span, "doc").filter("page >= begin AND page < first_body").groupBy("doc", "first_body").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    titles, numbers = (F.regexp_extract_all("text", F.lit(TOC_ENTRY), F.lit(g)) for g in (1, 2))
    each = listed.select("doc", "first_body", F.posexplode(F.arrays_zip(titles.alias("title"), numbers.alias("printed"))).alias("idx", "e"))
    return each.select("doc", "idx", F.trim("e.title").alias("title"), F.col("e.printed").cast("int").alias("printed"), "first_body")


def contents_sections(pages: DataFrame, marker: str = "Contents") -> DataFrame:
    """``doc, title, level, start_page, end_page`` by the printed contents: the first entry kept stands on the first page of the body.

    Of entries that share a printed page the last stays.  Level: the parts of a leading number such as 2.1, else 1.
    """
    entries = last_of_page(printed_contents(pages, marker).withColumnRenamed("printed", "start"))
    n = pages.groupBy("doc").agg((F.max("page") + 1).alias("n_pages"))
    w = Window.partitionBy("doc").orderBy("idx")
    offset = F.col("first_body") - F.first("start").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = entries.join(n, "doc").withColumn("at", F.col("start") + offset)
    last = F.col("n_pages") - 1
    clamp = lambda c, low: F.greatest(low, F.least(c, last))
    ended = placed.withColumn("end", F.greatest(F.coalesce(F.lead("at").over(w) - 1, last), F.col("at")))
    start = clamp(F.col("at"), F.lit(0))
    number = F.regexp_extract("title", "^(\\d+(?:\\.\\d+)*)\\s", 1)
    level = F.when(number != "", F.regexp_count(number, F.lit("\\.")) + 1).otherwise(1)
    return ended.select("doc", "title", level.cast("int").alias("level"), start.cast("int").alias("start_page"), clamp(F.col("end"), start).cast("int").alias("end_page"))


def chapter_sections(pages: DataFrame, heading: str, zones: Mapping[str, str], titles: DataFrame | None = None) -> DataFrame:
    """``doc, title, tag, start_page, end_page`` by chapter headings and zones behind the last chapter.

    A chapter ends before the next; the last one before the first zone, or with the document.  ``zones``: titles to the
    patterns of the pages they begin on.  ``titles``: ``doc, number, title`` where they are known.
    """
    n = pages.groupBy("doc").agg((F.max("page") + 1).alias("n_pages"))
    chapters = first_per_chapter(pages, heading)
    named = chapters if titles is None else chapters.join(titles, ["doc", "number"], "left")
    title = F.concat(F.lit("Chapter "), F.col("number").cast("string"))
    rows = named.select("doc", (title if titles is None else F.coalesce("title", title)).alias("title"), F.lit(None).cast("string").alias("tag"), "start", F.col("number").alias("ord"))
    behind = None
    for name, pattern in zones.items():
        zone = pages.filter(F.col("text").rlike(pattern)).groupBy("doc").agg(F.min("page").alias("start")).select("doc", F.lit(name).alias("title"), F.lit(name).alias("tag"), "start", F.lit(None).cast("int").alias("ord"))
        behind = zone if behind is None else behind.unionByName(zone)
    last = F.col("n_pages") - 1
    by_number = Window.partitionBy("doc").orderBy("ord")
    if behind is None:
        first_zone = n.select("doc", F.lit(None).cast("int").alias("zone"))
    else:
        first_zone = behind.groupBy("doc").agg(F.min("start").alias("zone"))
    ended = rows.join(n, "doc").join(first_zone, "doc", "left").withColumn("end", F.coalesce(F.lead("start").over(by_number) - 1, F.col("zone") - 1, last))
    out = ended.select("doc", "title", "tag", F.col("start").alias("start_page"), F.greatest("end", "start").alias("end_page"))
    if behind is not None:
        tail = behind.join(n, "doc").withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("start", "title")) - 1, last))
        out = out.unionByName(tail.select("doc", "title", "tag", F.col("start").alias("start_page"), F.greatest("end", "start").alias("end_page")))
    return out


def outside(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """Entries that begin in none of their document's intervals (``doc, lo, hi``, both ends included): an anti join by containment."""
    i = intervals.select(F.col("doc").alias("_doc"), "lo", "hi")
    return entries.join(i, (F.col("doc") == F.col("_doc")) & F.col("start").between(F.col("lo"), F.col("hi")), "left_anti")


def rich_outline(entries: DataFrame, pages: DataFrame, keep: Mapping[int, str], merged: str, split: str, part: str) -> DataFrame:
    """``doc, title, level, start_page, end_page`` of an outline with sheets that stand as one and a run that is split by page.

    Ends are found by level over the whole outline.  ``keep``: level to the whole-title pattern of entries that stay; ``merged``:
    the top-level title whose entries below it go into it; ``split``: the top-level title that is replaced by its pages that
    match ``part`` (a letter and a name as groups), each up to the next.
    """
    n = pages.groupBy("doc").agg((F.max("page") + 1).alias("n_pages"))
    order = F.row_number().over(Window.partitionBy("doc").orderBy("start", "idx"))
    ended = structure.level_ends(entries.withColumn("title", F.trim("title")).withColumn("idx", order).join(n, "doc"), F.col("n_pages"))
    top = lambda name: (F.col("level") == 1) & (F.col("title") == name)
    sheets = ended.filter(top(merged)).groupBy("doc").agg(F.min(F.struct("idx", "start", "end_page")).alias("s")).select("doc", F.col("s.start").alias("lo"), F.col("s.end_page").alias("hi"))
    good = F.lit(False)
    for level, pattern in keep.items():
        good = good | ((F.col("level") == level) & F.col("title").rlike(f"^(?:{pattern})$"))
    whole = lambda df: df.select("doc", "title", "level", F.col("start").alias("start_page"), "end_page")
    kept = whole(outside(ended.filter(good & ~top(merged) & ~top(split)), sheets)).unionByName(whole(ended.filter(top(merged))))
    run = ended.filter(top(split)).select(F.col("doc").alias("_doc"), F.col("start").alias("lo"), F.col("end_page").alias("hi"))
    hits = pages.join(run, (F.col("doc") == F.col("_doc")) & F.col("page").between(F.col("lo"), F.col("hi"))).filter(F.col("text").rlike(part))
    end = F.coalesce(F.lead("page").over(Window.partitionBy("doc", "lo").orderBy("page")) - 1, F.col("hi"))
    title = F.concat(F.lit("Appendix "), F.regexp_extract("text", part, 1), F.lit(": "), F.trim(F.regexp_extract("text", part, 2)))
    return kept.unionByName(hits.select("doc", title.alias("title"), F.lit(2).alias("level"), F.col("page").alias("start_page"), end.cast("int").alias("end_page")))


def clean_marked(text: Column, marker: str = ";\\s*\\d{1,2}\\s*;\\s*$", longest: int = 160) -> Column:
    """A page without lines that hold its number (- 12 -) or, if they are short, a garbled marker; legacy glyphs read, blank lines squeezed."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: ~(x.rlike("^\\s*-\\s*\\d+\\s*$") | ((F.length(x) < longest) & T.strip(x).rlike(marker))))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "(?U)\\s+$", "")), "\n")
    return T.strip(F.regexp_replace(T.legacy_glyphs(joined), "\n{3,}", "\n\n"))


# ---------------------------------------------------------------- rules by source


@dataclass(frozen=True)
class Rule:
    """How a source is cut: by its ``outline``, a ``fixed_toc``, its printed ``contents``, a function of its own (``custom``), or not at all (``skip``)."""

    file: str
    strategy: str
    structure: str = ""
    pages: int | None = None
    options: Mapping = field(default_factory=dict)
    cleaning: Mapping = field(default_factory=dict)
    callouts: Mapping[str, str] = field(default_factory=dict)
    flag: str = ""
    reason: str = ""


class Registry:
    """Rules by source key; files are known by their names, in one Unicode form."""

    def __init__(self, rules: Mapping[str, Rule], custom: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None):
        self.rules, self.custom = dict(rules), dict(custom or {})
        self._by_file = {nfc(r.file): key for key, r in self.rules.items()}

    def key_for(self, file: str) -> str | None:
        return self._by_file.get(nfc(file))

    def sections(self, file: str, entries: DataFrame, pages: DataFrame) -> tuple[DataFrame, str, bool]:
        """Sections (``doc, title, level, start_page, end_page, text, tags``), the kind of structure, and whether no rule was known.

        ``entries``: the outline, or, for a fixed table, ``doc, idx, title, page, keep``.  A skipped file, and a rule that leaves no
        section, are errors.
        """
        n = pages.groupBy("doc").agg((F.max("page") + 1).cast("int").alias("n_pages"))
        key = self.key_for(file)
        if key is None:
            none = pages.select("doc", F.col("page").cast("int").alias("page"), F.lit("").alias("title")).limit(0)
            return finished(structure.fallback_sections(entries, none, n), pages), "generic", True
        rule = self.rules[key]
        if rule.strategy == "skip":
            raise ValueError(f"{file} is marked skip: {rule.reason}")
        cols = ["doc", "title", "level", F.col("start").alias("start_page"), "end_page"]
        if rule.strategy == "outline":
            cut = structure.outline_sections(entries.join(n, "doc"), F.col("n_pages"), **rule.options).select(*cols)
        elif rule.strategy == "fixed_toc":
            cut = structure.fixed_sections(entries.join(n, "doc").withColumn("level", F.lit(1)), F.col("n_pages")).select(*cols)
        elif rule.strategy == "contents":
            cut = contents_sections(pages, **rule.options)
        elif rule.strategy == "custom":
            cut = self.custom[key](entries, pages)
        else:
            raise ValueError(f"{key}: unknown strategy {rule.strategy!r}")
        out = finished(cut, pages, rule)
        if out.isEmpty():
            raise ValueError(f"{key}: no section is left, see its rule")
        return out, rule.structure, False


def finished(sections: DataFrame, pages: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Sections with their texts, cleaned, and the tags of the call-outs in them."""
    rule = rule or Rule("", "")
    out = structure.section_text(sections, pages, **rule.cleaning)
    return out.withColumn("tags", T.callouts(F.col("text"), dict(rule.callouts)))


def flagged_pages(sections: DataFrame, pages: DataFrame, flag: str) -> DataFrame:
    """``doc, page``: pages of sections that match ``flag``."""
    own = sections.select("doc", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()
    return pages.filter(F.col("text").rlike(flag)).join(own, ["doc", "page"], "left_semi").select("doc", "page")
