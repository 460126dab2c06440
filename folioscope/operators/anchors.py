"""Anchors: where a book's titles stand in its pages, in their order, though letters are garbled and lines repeat.

A line is a candidate for a title if they share enough trigrams of their folded text.  Of all candidates the best chain is
taken, in which both titles and places go forward: the one with the greatest sum of likenesses.  From anchors follow the
sections between them.

Defined cases: titles that no line is like have no anchor; two titles never stand in one place, nor one title in two; of equal
chains the one that begins earliest holds; null and empty texts are like nothing; a text of fewer than three letters has
itself as its one trigram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 700  # thousandths of likeness
_AT = 1_000_000  # more than a book has candidates


def folded(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's folded form."""
    def of(letters: Column) -> Column:
        at = lambda i: F.coalesce(F.get(letters, i), F.lit(""))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(letters) - 3, F.lit(0))), lambda i: F.concat(at(i), at(i + 1), at(i + 2))))

    # the letters are bound by a lambda, which works them out once
    t = folded(F.coalesce(text, F.lit("")))
    each = F.transform(F.array(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))), lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<string>")))
    return F.element_at(each, 1)


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc, page, text`` to ``doc, page, off, text``: lines that aren't blank, with their first character's place in the page."""
    line = F.split("text", "\n")
    start = F.aggregate(line, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    each = pages.filter("text IS NOT NULL").select("doc", "page", F.posexplode(F.arrays_zip(line.alias("text"), F.slice(start, F.lit(1), F.size(line)).alias("off"))).alias("i", "l"))
    return each.select("doc", "page", "l.off", "l.text").filter(folded(F.col("text")) != "")


def candidates(lines: DataFrame, titles: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc, idx, page, off, score``: twice the trigrams that a line and a title share to all they have, in thousandths.

    A join on the trigrams of one book; lines that are too long for the book's longest title don't take part.
    """
    t = titles.select("doc", "idx", trigrams(F.col("title")).alias("grams")).withColumn("have", F.size("grams")).filter("have > 0")
    longest = t.groupBy("doc").agg((F.max("have") * (2000 - least) / least).alias("most"))
    x = lines.select("doc", "page", "off", trigrams(F.col("text")).alias("grams")).withColumn("size", F.size("grams")).join(longest, "doc").filter("size <= most")
    met = x.select("doc", "page", "off", "size", F.explode("grams").alias("gram")).join(t.select("doc", "idx", "have", F.explode("grams").alias("gram")), ["doc", "gram"])
    counted = met.groupBy("doc", "idx", "page", "off", "size", "have").agg(F.count(F.lit(1)).alias("common"))
    return counted.select("doc", "idx", "page", "off", F.floor(2000 * F.col("common") / (F.col("size") + F.col("have"))).cast("int").alias("score")).filter(F.col("score") >= least)


def best_chain(found: DataFrame) -> DataFrame:
    """``doc, idx, page, off, score`` to the rows of each book's best chain. Two folds over a book's candidates, which stand in one row."""
    none = F.array().cast("array<struct<at: int, idx: int, page: int, off: int, score: int, total: long, prev: int>>")

    def step(s: Column, c: Column) -> Column:
        before = F.filter(s, lambda x: (x["idx"] < c["idx"]) & ((x["page"] < c["page"]) | ((x["page"] == c["page"]) & (x["off"] < c["off"]))))
        top = F.array_max(F.transform(before, lambda x: x["total"] * _AT - x["at"]))  # the greatest sum, then the earliest
        total = F.coalesce(F.ceil(top / _AT), F.lit(0)).cast("long")
        prev = F.coalesce((total * _AT - top).cast("int"), F.lit(-1))
        return F.concat(s, F.array(F.struct(F.size(s).alias("at"), c["idx"].alias("idx"), c["page"].alias("page"), c["off"].alias("off"), c["score"].alias("score"), (total + c["score"]).alias("total"), prev.alias("prev"))))

    def back(s: Column, x: Column) -> Column:
        hit = x["at"] == s["want"]
        return F.struct(F.when(hit, x["prev"]).otherwise(s["want"]).alias("want"), F.when(hit, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    rows = found.select("doc", F.struct(F.col("page").cast("int").alias("page"), F.col("off").cast("int").alias("off"), F.col("idx").cast("int").alias("idx"), "score").alias("c"))
    whole = rows.groupBy("doc").agg(F.array_sort(F.collect_list("c")).alias("cs")).select("doc", F.aggregate("cs", none, step).alias("s"))
    top = F.array_max(F.transform("s", lambda x: x["total"] * _AT - x["at"]))
    last = whole.withColumn("want", (F.ceil(top / _AT).cast("long") * _AT - top).cast("int"))
    chain = F.aggregate(F.reverse("s"), F.struct(F.col("want").alias("want"), none.alias("out")), back)["out"]
    return last.select("doc", F.explode(chain).alias("x")).select("doc", "x.idx", "x.page", "x.off", "x.score")


def anchors(pages: DataFrame, titles: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc, page, text`` and ``doc, idx, title`` to ``doc, idx, title, page, off, score``."""
    chain = best_chain(candidates(page_lines(pages), titles, least))
    return titles.select("doc", F.col("idx").cast("int").alias("idx"), "title").join(chain, ["doc", "idx"])


def spans(found: DataFrame) -> DataFrame:
    """Adds ``end_page, end_off``: where the next anchor of the book stands, null for the last: what :func:`structure.page_slices` cuts."""
    w = Window.partitionBy("doc").orderBy("page", "off")
    return found.withColumn("end_page", F.lead("page").over(w)).withColumn("end_off", F.lead("off").over(w))
