"""Answers as HTML: a little Markdown, cards, tables. Plain Python on the driver; :func:`markdown_column` for tables of answers."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by language.
LABELS = {
    "EN": {"question": "Question", "answer": "Answer", "short": "Short answer", "Yes": "Yes", "No": "No", "excerpts": "{n} excerpts (best of {c} candidates)", "pages": "pages", "understood": "Understood as", "grounding": "established on"},
    "RU": {"question": "Вопрос", "answer": "Ответ", "short": "Краткий ответ", "Yes": "Да", "No": "Нет", "excerpts": "{n} фрагментов (лучшие из {c} кандидатов)", "pages": "страницы", "understood": "Понято как", "grounding": "опирается на"},
}

# What is bold, code and italic in a line.
_SPAN = re.compile(r"\*\*(?P<b>.+?)\*\*|`(?P<code>[^`]+)`|(?<![*\w])\*(?!\s)(?P<i>.+?)(?<!\s)\*(?![*\w])")


def labels(language: str | None = "EN") -> dict[str, str]:
    """Labels of a language; English where there are none."""
    return LABELS.get((language or "EN").upper(), LABELS["EN"])


def spans(text: str) -> str:
    """Bold, italics and code of one line; all else escaped."""
    out, at = [], 0
    for m in _SPAN.finditer(text):
        tag = m.lastgroup
        inner = html.escape(m[tag]) if tag == "code" else spans(m[tag])
        out += [html.escape(text[at : m.start()]), f"<{tag}>{inner}</{tag}>"]
        at = m.end()
    return "".join([*out, html.escape(text[at:])])


def _kind(line: str) -> tuple[str, str]:
    if not line:
        return "", ""
    if m := re.match(r"#{1,6}\s+(.*)", line):
        return "h4", m[1]
    if m := re.match(r"[-*•]\s+(.*)", line):
        return "li", m[1]
    return "p", line


def markdown(text: str) -> str:
    """Headings, paragraphs and lists to HTML: neighbouring lines of one kind belong together."""
    out = []
    for kind, lines in groupby((_kind(x.strip()) for x in text.splitlines()), key=lambda k: k[0]):
        body = [spans(t) for _, t in lines]
        if kind == "h4":
            out += [f"<h4>{t}</h4>" for t in body]
        elif kind == "li":
            out.append("<ul>" + "".join(f"<li>{t}</li>" for t in body) + "</ul>")
        elif kind == "p":
            out.append("<p>" + "<br>".join(body) + "</p>")
    return "".join(out)


def markdown_column(text: Column) -> Column:
    """:func:`markdown` over a table, in Arrow batches."""

    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(markdown, na_action="ignore")

    return each(text)


def format_pages(pages: Sequence[int]) -> str:
    """Pages as ranges, as in 3-5, 13-14, 20; none: a dash."""
    runs = groupby(enumerate(sorted(set(pages))), key=lambda x: x[1] - x[0])
    ends = [(g[0][1], g[-1][1]) for g in (list(r) for _, r in runs)]
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in ends) or "-"


def card(number: int, result: dict, language: str = "EN") -> str:
    """One question and its answer."""
    t, short = labels(language), result.get("short_answer")
    body = re.sub(r"\A\s*Short answer:\s*(Yes|No)\s*\n*", "", result["answer"], flags=re.I)
    badge = f'<div class="badge {short.lower()}">{t["short"]}: {t[short]}</div>' if short else ""
    query = f'<p>{t["understood"]}: {html.escape(result["retrieval_query"])}</p>' if result["retrieval_query"] != result["question"] else ""
    foot = f'{t["excerpts"].format(n=result["chunks_used"], c=result["candidates_considered"])}; {t["pages"]} {format_pages(result["source_pages"])}; {t["grounding"]} {html.escape(", ".join(result["grounding_words"]) or "-")}'
    return f'<section><h3>{t["question"]} {number}</h3><p>{html.escape(result["question"])}</p>{query}<h3>{t["answer"]}</h3>{badge}{markdown(body)}<footer>{foot}</footer></section>'


def summary(rows: Sequence[Sequence], columns: Sequence[str]) -> str:
    """A table of cells, all escaped."""
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return f"<table>{line(columns, 'th')}{''.join(line(r, 'td') for r in rows)}</table>"
