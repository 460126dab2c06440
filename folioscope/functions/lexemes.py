"""Terms of full-text search: tokens in any script, English stop words out, English words by their stems.

The stemmer follows the published description of the second Porter stemmer, without its lists of single words.  It is a
chain of expressions over a column of distinct words, so it stays in the JVM; the same steps read as SQL in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers with their point, else runs of letters, marks and digits.
TOKEN = "[0-9]+[.][0-9]+|[\\p{L}\\p{M}\\p{N}]+"

# The English words that full-text search leaves out.
STOP = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)


def _has(pattern: str, of: str = "pre") -> str:
    return f"regexp_extract({of}, '{pattern}', 0) <> ''"


#: What stands before a suffix reaches into the word's first or second region.
_R1, _R2 = _has("[aeiouy][^aeiouy]"), _has("[aeiouy][^aeiouy].*[aeiouy][^aeiouy]")
_SHORT_END = f"({_has('[^aeiouy][aeiouy][^aeiouywxY]$')} OR {_has('^[aeiouy][^aeiouy]$')})"
_SHORT_WORD = f"({_has('^[^aeiouy]+[aeiouy][^aeiouywxY]$')} OR {_has('^[aeiouy][^aeiouy]$')})"


def _case(endings: dict[str, str], region: str, special: str = "") -> str:
    return "CASE WHEN suf = '' THEN w " + special + "".join(f"WHEN suf = '{a}' AND {region} THEN pre || '{b}' " for a, b in endings.items()) + "ELSE w END"


# Endings and what takes their place, by step.
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = {x: "" for x in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")}

#: Each step: the endings it looks for, the longest first found, and the new word from ``w``, ``suf`` and ``pre``.
STEPS: tuple[tuple[str, str], ...] = (
    (
        "sses|ied|ies|us|ss|s",
        f"CASE WHEN suf = 'sses' THEN pre || 'ss' WHEN suf IN ('ied', 'ies') THEN CASE WHEN length(pre) > 1 THEN pre || 'i' ELSE pre || 'ie' END WHEN suf = 's' AND {_has('[aeiouy].')} THEN pre ELSE w END",
    ),
    (
        "eedly|eed|ingly|edly|ing|ed",
        f"CASE WHEN suf = '' THEN w WHEN suf IN ('eed', 'eedly') THEN CASE WHEN {_R1} THEN pre || 'ee' ELSE w END WHEN NOT {_has('[aeiouy]')} THEN w "
        f"WHEN {_has('(at|bl|iz)$')} THEN pre || 'e' WHEN {_has('(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN substr(pre, 1, length(pre) - 1) WHEN {_SHORT_WORD} THEN pre || 'e' ELSE pre END",
    ),
    ("[yY]", f"CASE WHEN suf <> '' AND {_has('.[^aeiouy]$')} THEN pre || 'i' ELSE w END"),
    (
        "|".join(sorted([*_SECOND, "ogi", "li"], key=lambda x: -len(x))),
        _case(_SECOND, _R1, f"WHEN suf = 'ogi' AND {_R1} AND {_has('l$')} THEN pre || 'og' WHEN suf = 'li' AND {_R1} AND {_has('[cdeghkmnrt]$')} THEN pre "),
    ),
    ("|".join(sorted([*_THIRD, "ative"], key=lambda x: -len(x))), _case(_THIRD, _R1, f"WHEN suf = 'ative' AND {_R2} THEN pre ")),
    ("|".join(sorted([*_FOURTH, "ion"], key=lambda x: -len(x))), _case(_FOURTH, _R2, f"WHEN suf = 'ion' AND {_R2} AND {_has('[st]$')} THEN pre ")),
    ("e|l", f"CASE WHEN suf = 'e' AND ({_R2} OR ({_R1} AND NOT {_SHORT_END})) THEN pre WHEN suf = 'l' AND {_R2} AND {_has('l$')} THEN pre ELSE w END"),
)
_CONSONANT_Y = "concat(replace(substr(word, 1, 1), 'y', 'Y'), replace(replace(replace(replace(replace(substr(word, 2), 'ay', 'aY'), 'ey', 'eY'), 'iy', 'iY'), 'oy', 'oY'), 'uy', 'uY'))"
_ENGLISH = f"length(word) > 2 AND {_has('^[a-z]+$', 'word')}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stem(word: str = "word") -> Column:
    """The stem of a lower-case word; words of other than a to z stay as they are.

    The steps run in lambdas over an array of one word, so that each step reads the one before by name: as plain columns the
    optimiser would put every step's text into the next, many times over.
    """
    of = lambda sql: re.sub(r"\b(w|suf|pre)\b", r"x.\1", sql)
    sql = f"array({_CONSONANT_Y})".replace("word", word)
    for endings, new in STEPS:
        sql = f"transform({sql}, x -> named_struct('w', x, 'suf', regexp_extract(x, '({endings})$', 1)))"
        sql = f"transform({sql}, x -> named_struct('w', x.w, 'suf', x.suf, 'pre', substr(x.w, 1, length(x.w) - length(x.suf))))"
        sql = f"transform({sql}, x -> {of(new)})"
    return F.expr(f"coalesce(CASE WHEN {_ENGLISH.replace('word', word)} THEN lower(({sql})[0]) ELSE {word} END, '')")


def stemmed(rows: DataFrame, out: str = "term") -> DataFrame:
    """Adds ``out``, the stem of the column ``word``."""
    return rows.withColumn(out, stem())


def stemmed_sql(rows: str) -> str:
    """The same in DuckDB: ``rows`` is a query with a column ``word``; the result has ``term`` as well."""
    sql = f"SELECT *, CASE WHEN {_ENGLISH} THEN {_CONSONANT_Y} ELSE word END AS w FROM ({rows})"
    for endings, new in STEPS:
        sql = f"SELECT *, substr(w, 1, length(w) - length(suf)) AS pre FROM (SELECT *, regexp_extract(w, '({endings})$', 1) AS suf FROM ({sql}))"
        sql = f"SELECT * EXCLUDE (w, suf, pre), CASE WHEN {_ENGLISH} THEN {new} ELSE word END AS w FROM ({sql})"
    return f"SELECT * EXCLUDE (w), lower(w) AS term FROM ({sql})"


def words(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """``guid, text`` to ``guid, word, n``: how often each text has a word, stop words apart. ``keep``: a condition on ``word`` before anything moves."""
    each = rows.select("guid", F.explode(tokens(F.col("text"))).alias("word")).filter(~F.col("word").isin(*STOP))
    if keep is not None:
        each = each.filter(keep)
    return each.groupBy("guid", "word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counted: DataFrame) -> DataFrame:
    """``word, term`` of all words: each is stemmed once."""
    return stemmed(counted.select("word").distinct())


COMMON = 1 << 16  # words whose stems go to all tasks


def occurrences(rows: DataFrame, *carry: str) -> DataFrame:
    """``guid, text`` to ``guid, *carry, word``: a row for each word of a text, stop words apart."""
    return rows.select("guid", *carry, F.explode(tokens(F.col("text"))).alias("word")).filter(~F.col("word").isin(*STOP))


def lexemes(rows: DataFrame, *carry: str) -> DataFrame:
    """``guid, text`` to ``guid, *carry, term, tf``: how often each text has a term.

    The most frequent words' stems are found once and go to all tasks; other words, most of which stand in few texts, are
    stemmed where they stand.  Texts are dealt by ``guid`` and counted there: occurrences and counts don't move.
    """
    each = occurrences(rows.select("guid", *carry, "text").repartition("guid"), *carry)
    often = occurrences(rows).groupBy("word").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "word").limit(COMMON)
    named = each.join(F.broadcast(stemmed(often.select("word"), "known")), "word", "left")
    return named.groupBy("guid", *carry, F.coalesce("known", stem()).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


PREFIX = 5


def may_have(stems: list[str]) -> Column:
    """Whether ``word`` may have one of the stems: but for a stem's last letter, a word begins as its stem does."""
    by_length: dict[int, set[str]] = {}
    for s in stems:
        k = max(1, min(PREFIX, len(s) - 1))
        by_length.setdefault(k, set()).add(s[:k])
    out = F.lit(False)
    for k, starts in sorted(by_length.items()):
        out = out | F.substring("word", 1, k).isin(*sorted(starts))
    return out
