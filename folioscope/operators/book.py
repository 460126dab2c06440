"""Questions to one book: its status, messages, answers within it, and a comparison of what raw and prepared questions find."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..plans import prompts
from ..plans.providers import Providers
from . import answer, search, sync


def find_book(sources: DataFrame, pages: DataFrame, chunks: DataFrame, pattern: str) -> Row:
    """:func:`sync.book_status` of the one book that is meant; LookupError where there is none."""
    got = sync.book_status(sources, pages, chunks, pattern).collect()
    if not got:
        raise LookupError(f"no book like {pattern}: recognise and upload it first")
    return got[0]


def readiness(status: Row) -> str:
    """How much of the book there is, and what to do if that isn't all."""
    want = status["page_count"] if status["page_count"] is not None else "an unknown number of"
    line = f"{status['source_key']}: {status['pages']} of {want} pages recognised, {status['chunks']} chunks embedded"
    return line if status["ready"] else f"{line}\nnot ready: run the recognise, upload and chunks jobs without a page limit"


def prompt_message(prompt: str) -> str:
    """Which prompt is in use, and whether it keeps the line that short answers are read from."""
    if prompt == prompts.ANSWER:
        return "the built-in prompt"
    return f"a prompt of {len(prompt)} characters" + ("" if "Short answer" in prompt else "; it has no Short answer line, so answers get no yes or no")


@dataclass
class BookQA:
    """Asks one book: hybrid search of sub-questions, reranked, within the book, in one language."""

    spark: SparkSession
    corpus: answer.Corpus
    status: Row
    providers: Providers
    language: str = "EN"
    n: int = 6
    prompt: str = ""

    def prepare(self, question: str) -> answer.Prepared:
        return answer.understand(question, lambda q: self.providers.text.reply("understand", q))

    def ask(self, question: str, prepared: answer.Prepared | None = None, **changes) -> answer.Answer:
        prepared = prepared or self.prepare(question)
        flags = answer.Flags(n=self.n, hybrid=True, multi_query=True, rerank=True, owner=self.status["guid"], answer_language=self.language, system_prompt=self.prompt.strip() or prompts.ANSWER)
        return answer.ask(self.spark, self.corpus, question, self.providers, replace(flags, **changes), prepared.query)

    def ask_all(self, questions: list[str], **changes) -> tuple[list[answer.Answer], str]:
        """All answers, and their cards with a table below, as HTML."""
        got = [self.ask(q, **changes) for q in questions]
        cards = [display.card(i, a.result(), self.language) for i, a in enumerate(got, 1)]
        table = display.summary([(i, a.short or "-", len(a.used["sub_questions"]), len(a.rows), a.question[:80]) for i, a in enumerate(got, 1)], ["#", "short answer", "sub-questions", "excerpts", "question"])
        return got, "".join(cards) + table

    def compare_retrieval(self, question: str, n: int = 5) -> DataFrame:
        """``form, rank, guid, dense_rank, keyword_rank``: what the question as it stands finds, and what its prepared form finds."""
        forms = [("raw", question), ("prepared", self.prepare(question).query)]
        vectors = self.providers.embedder.embed([q for _, q in forms], "query")
        rows = [(form, q, [float(x) for x in v]) for (form, q), v in zip(forms, vectors, strict=True)]
        asked = self.spark.createDataFrame(rows, "query_id string, text string, vector array<double>")
        terms = search.terms_of(asked.withColumn("text", F.col("text")))
        return search.hybrid_search(self.corpus.chunks, asked, terms, n, owner=self.status["guid"]).select(F.col("query_id").alias("form"), "rank", "guid", "dense_rank", "keyword_rank")
