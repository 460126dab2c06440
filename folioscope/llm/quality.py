"""Quality rules as a bitmask ledger.

Every rule is measured once for each text.  The ledger keeps the measurements and a mask with one bit for each rule
that the text fails.  A policy is a versioned choice of rules; it is applied to the stored mask, so another policy, or
the question what a policy would do without one of its rules, reads the ledger and no text.

Texts alone go to the measuring function, which gives numbers back; all other columns stay where they are.

Defined cases: a null text counts as empty; an empty text has no words and fails ``few_words``; equal rows get equal
ledger rows; an empty table gives an empty ledger; other columns stay, and in ``ledger`` those with the name of a
measurement or of the mask are replaced by it; ``keep_good`` gives back all columns as they were, whatever their names;
very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_buffers, bounded, carried, hashed_words, pieces, text_bytes, windows

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an expression over the measurements; ``bit`` never changes its meaning between versions."""

    bit: int
    name: str
    fails: Column | str


#: Fixed bits. Ratios are products of whole numbers, so that every engine agrees on them.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_mean_word", "10 * word_chars < 25 * n_words"),
    Rule(5, "long_mean_word", "10 * word_chars > 120 * n_words"),
    Rule(6, "few_alphabetic_words", "100 * n_alpha_words < 70 * n_words"),
    Rule(7, "very_many_words", "n_words > 100000"),
)

#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_mean_word", "long_mean_word", "few_alphabetic_words"),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


_ALPHA = np.zeros(256, bool)
_ALPHA[ord("a") : ord("z") + 1] = _ALPHA[ord("A") : ord("Z") + 1] = True
_ALPHA[128:] = True  # any part of a character beyond ASCII


def _measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of MEASURES for each text."""
    out = np.zeros((len(offsets) - 1, len(MEASURES)), np.int64)
    for a, b in pieces(offsets):
        off = offsets[a : b + 1]
        h, starts, ends, of = hashed_words(data, off, lower=False)
        chunk = data[off[0] : off[-1]]
        rel = off - off[0]
        points = np.zeros(len(chunk) + 1, np.int64)  # code points before each byte
        np.cumsum((chunk & 0xC0) != 0x80, out=points[1:])
        chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[chunk])))
        letters = np.concatenate(([0], np.cumsum(_ALPHA[chunk])))
        alpha = np.concatenate(([0], np.cumsum(letters[ends] > letters[starts])))
        breaks = np.flatnonzero(chunk == 10)
        first_break = np.searchsorted(breaks, rel)
        rows = out[a:b]
        rows[:, 0] = of[1:] - of[:-1]
        rows[:, 1] = chars[of[1:]] - chars[of[:-1]]
        rows[:, 2] = symbols[rel[1:]] - symbols[rel[:-1]]
        rows[:, 6] = alpha[of[1:]] - alpha[of[:-1]]
        for i in range(b - a):
            w = h[of[i] : of[i + 1]]
            if len(w) >= 3:
                rows[i, 4] = _repeated(windows(w, 3), len(w))
            if len(w):
                lo, hi = first_break[i], first_break[i + 1]
                if hi == lo:
                    rows[i, 5] = 1
                else:
                    rows[i, 5], rows[i, 3] = _lines(chunk[rel[i] : rel[i + 1]].tobytes())
    return out


def _repeated(grams: np.ndarray, n: int) -> int:
    """Words inside a window that the text has twice or more."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 3, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measures(text: Column) -> Column:
    """A struct of MEASURES for each text: one pass, no shuffle, and only the text leaves the JVM."""

    @F.arrow_udf("struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        got = _measure(*binary_buffers(texts))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[:, j])) for j in range(len(MEASURES))], names=list(MEASURES))

    return measure(text)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of each text."""
    bounded(docs.sparkSession)
    keep = [c for c in docs.columns if c not in MEASURES and c != "failed_rules"]
    rows = carried(docs.select(*[F.col(f"`{c}`") for c in keep]), measures(text_bytes(text)).alias("found"))
    return rows.select("row.*", "found.*") if keep else rows.select("found.*")


def failure_mask() -> Column:
    """One bit for each failed rule."""
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out + F.when(F.expr(r.fails) if isinstance(r.fails, str) else r.fails, F.lit(1 << r.bit)).otherwise(0).cast("long")
    return out


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failed_rules``, the mask."""
    return measured(docs, text).withColumn("failed_rules", failure_mask())


def apply_policy(entries: DataFrame, policy: str = "v1", column: str = "kept") -> DataFrame:
    """Adds the policy's verdict, from the mask alone."""
    return entries.withColumn(column, F.col("failed_rules").bitwiseAND(policy_mask(policy)) == 0)


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: texts that fail it, and texts that only this rule rejects (the gain without it).

    One aggregation over the masks: first a count for each mask (at most 2^rules rows), then sums over its bits.
    """
    mask = policy_mask(policy)
    by_mask = entries.groupBy(F.col("failed_rules").bitwiseAND(mask).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules]))
    spread = by_mask.select("m", "n", rows.alias("r")).select("m", "n", "r.rule", "r.bit")
    return spread.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(F.col("m") != 0, F.col("n")).otherwise(0)).alias("rejected"),
    )


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns and no more."""
    bounded(docs.sparkSession)
    rows = carried(docs, measures(text_bytes(text)).alias("found")).select("row", "found.*")
    return apply_policy(rows.withColumn("failed_rules", failure_mask()), policy).filter("kept").select("row.*")
