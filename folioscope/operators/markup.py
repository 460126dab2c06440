"""Text of blocks made ready for translation: hyphens joined, foreign runs and superscripts marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = ("sa", "la")


def dehyphenate(words: Column) -> Column:
    """``array<struct<text, lang, style, bbox>>``: a word with a hyphen at a line's end takes the next, lower-case one in."""

    def step(s: Column, w: Column) -> Column:
        last = F.element_at(s, -1)
        joins = (F.size(s) > 0) & last["open"] & last["text"].endswith("-") & (F.length(last["text"]) > 1) & (w["bbox"]["y"] > last["bbox"]["y"] + last["bbox"]["h"] * 0.5) & w["text"].rlike("^\\p{Ll}")
        whole = F.concat(F.substring(last["text"], F.lit(1), F.length(last["text"]) - 1), w["text"])
        joined = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(last.withField("text", whole).withField("open", F.lit(False))))
        return F.when(F.size(s) == 0, F.array(w.withField("open", F.lit(True)))).when(joins, joined).otherwise(F.concat(s, F.array(w.withField("open", F.lit(True)))))

    opened = F.transform(words, lambda w: w.withField("open", F.lit(True)))
    start = F.filter(opened, lambda w: F.lit(False))
    return F.transform(F.aggregate(words, start, step), lambda w: w.dropFields("open"))


def mark_source(words: Column) -> Column:
    """The block's text with runs of kept languages in [[..]] and superscripts in <sup>..</sup>."""
    kept = lambda w: w["lang"].isin(*KEPT)
    plain = lambda w: F.when(w["style"] == "sup", F.concat(F.lit("<sup>"), w["text"], F.lit("</sup>"))).otherwise(w["text"])
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("run"))

    def step(s: Column, w: Column) -> Column:
        space = F.when(s["text"] == "", F.lit("")).otherwise(F.lit(" "))
        text = (
            F.when(kept(w) & s["run"], F.concat(s["text"], F.lit(" "), w["text"]))
            .when(kept(w), F.concat(s["text"], space, F.lit("[["), w["text"]))
            .when(s["run"], F.concat(s["text"], F.lit("]] "), plain(w)))
            .otherwise(F.concat(s["text"], space, plain(w)))
        )
        return F.struct(text.alias("text"), kept(w).alias("run"))

    done = F.aggregate(dehyphenate(words), start, step, lambda s: F.when(s["run"], F.concat(s["text"], F.lit("]]"))).otherwise(s["text"]))
    return F.replace(done, F.lit("­"), F.lit(""))
