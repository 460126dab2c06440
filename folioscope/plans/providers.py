"""Providers: models behind small interfaces, each with a deterministic offline form.

A provider is passed explicitly and never kept in a module; what runs on executors is created there, once a partition.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.search import overlap_score
from . import prompts


class Embedder(Protocol):
    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, question: str, text: Column) -> Column: ...


class TextModel(Protocol):
    def reply(self, task: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of words: equal texts have equal vectors, shared words bring them nearer."""

    dim: int = 64

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


@dataclass(frozen=True)
class OverlapReranker:
    def score(self, question: str, text: Column) -> Column:
        return overlap_score(F.lit(question), text)


@dataclass
class RecordedText:
    """Replies by task, in order; the last one is repeated. Prompts are kept for tests."""

    replies: dict[str, list[str]]
    prompts: list[tuple[str, str]] = field(default_factory=list)

    def reply(self, task: str, prompt: str) -> str:
        self.prompts.append((task, prompt))
        known = self.replies.get(task, [""])
        return known[min(sum(t == task for t, _ in self.prompts), len(known)) - 1]


@dataclass
class Providers:
    embedder: Embedder = field(default_factory=HashEmbedder)
    reranker: Reranker = field(default_factory=OverlapReranker)
    text: TextModel = field(default_factory=lambda: RecordedText({}))


REGISTRY: dict[str, Callable[[], Providers]] = {"offline": Providers}


def providers(name: str = "offline") -> Providers:
    """Providers by name; an unknown name is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}: one of {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def with_retry(call: Callable, attempts: int = 5, base: float = 2.0, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """Calls until it succeeds, with exponential waits and jitter; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not retryable(e):
                raise
            sleep(base * 2**k + random.uniform(0, 1))


def embed_column(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = 20) -> DataFrame:
    """Adds ``embedding``: texts go to the provider in batches, from each partition, with retries."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = f[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                out += with_retry(lambda i=i, texts=texts: embedder.embed(texts[i : i + batch], "document"))
            yield f.assign(embedding=out)

    return rows.mapInPandas(run, schema)


def translate_missing(units: DataFrame, cache: DataFrame, translate: Callable[[list[str]], list[str]] | Callable[[dict], dict], rounds: int = 2) -> DataFrame:
    """``id, text`` to ``id, text, translated``: cached translations stay, the rest is asked for, blanks once more.

    ``cache``: ``id, translated``; of several for one id the greatest holds.  ``translate`` takes a mapping of ids to texts
    and gives one of ids to translations, or takes and gives lists in one order.  Replies to ids that weren't asked for,
    and blank ones, count for nothing; what is missing in the end has null.  Ids keep their type.
    """
    good = cache.filter("translated IS NOT NULL AND trim(translated) <> ''").groupBy("id").agg(F.max("translated").alias("translated"))
    known = units.select("id", "text").join(good, "id", "left")
    by_id = bool(getattr(translate, "by_id", False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = {k: t for k, t in zip(f["id"], f["translated"], strict=True) if t is not None}
            texts = dict(zip(f["id"], f["text"], strict=True))
            for _ in range(rounds):
                todo = {k: t for k, t in texts.items() if k not in done}
                if not todo:
                    break
                got = translate(todo) if by_id else dict(zip(todo, translate(list(todo.values())), strict=True))
                done |= {k: t.strip() for k, t in got.items() if k in todo and t and t.strip()}
            yield f.assign(translated=[done.get(k) for k in f["id"]])[["id", "text", "translated"]]

    return known.select("id", "text", "translated").mapInPandas(run, known.select("id", "text", "translated").schema)


def translate_units(pages: DataFrame, translate: Callable[[dict], dict], prompt: str, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``source_key, page, previous_context, units`` to ``source_key, page, id, source, translated, error``: a request for each page, and one more for blocks it left out.

    ``translate`` gets ``prompt``, ``page``, ``previous_context`` and ``blocks``, and gives ``translations`` with ``id`` and ``text``.
    Replies to ids that weren't asked for, and blank ones, count for nothing.  A page whose request fails to the end has ``error``.
    """

    def ask(row, todo: list[dict]) -> dict[str, str]:
        payload = {"prompt": prompt, "page": int(row.page), "previous_context": row.previous_context or "", "blocks": todo}
        wanted = {u["id"] for u in todo}
        got = with_retry(lambda: translate(payload), attempts, sleep=sleep).get("translations", [])
        return {t["id"]: t["text"].strip() for t in got if t.get("id") in wanted and (t.get("text") or "").strip()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for row in f.itertuples():
                units = [{k: (list(v) if k == "section_path" and v is not None else v) for k, v in u.items()} for u in row.units]
                done, error = {}, None
                try:
                    for _ in range(2):
                        if todo := [u for u in units if u["id"] not in done]:
                            done |= ask(row, todo)
                except Exception as e:  # noqa: BLE001  whatever a model may raise
                    error = f"{type(e).__name__}: {e}"[:300]
                rows += [(row.source_key, row.page, u["id"], u["text"], done.get(u["id"]), error) for u in units]
            yield pd.DataFrame(rows, columns=["source_key", "page", "id", "source", "translated", "error"])

    return pages.select("source_key", "page", "previous_context", "units").mapInPandas(run, "source_key string, page int, id string, source string, translated string, error string")


# ---------------------------------------------------------------- recognition


class Recogniser(Protocol):
    """A page image to a mapping of the page schema's shape."""

    def recognise(self, image: bytes, prompt: str, schema: dict) -> dict: ...


class Ocr(Protocol):
    """A file to the texts of its pages."""

    def read(self, content: bytes, dpi: int = 150, psm: int = 6) -> list[str]: ...


def json_reply(reply: str) -> dict:
    """The object of a reply that was asked for JSON, with or without a fence about it."""
    got = json.loads(re.sub(r"\A\s*```(?:json)?|```\s*\Z", "", reply))
    if not isinstance(got, dict):
        raise ValueError("the reply is no object")
    return got


def tool_reply(content: list[dict], name: str) -> dict:
    """The input of the tool that a reply calls by name: tools force the reply's shape."""
    for part in content:
        if part.get("type") == "tool_use" and part.get("name") == name:
            return part["input"]
    raise ValueError(f"the reply doesn't call {name}")


@dataclass
class JsonRecogniser:
    """Recognition by a model that replies in JSON: ``call(image, prompt, schema)`` gives its text."""

    call: Callable[[bytes, str, dict], str]

    def recognise(self, image: bytes, prompt: str, schema: dict) -> dict:
        return json_reply(self.call(image, prompt, schema))


@dataclass
class ToolRecogniser:
    """Recognition by a model that is made to call a tool: ``call(image, prompt, tool)`` gives the parts of its reply."""

    call: Callable[[bytes, str, dict], list[dict]]
    name: str = "page"

    def recognise(self, image: bytes, prompt: str, schema: dict) -> dict:
        return tool_reply(self.call(image, prompt, {"name": self.name, "input_schema": schema}), self.name)


@dataclass(frozen=True)
class LineOcr:
    """The offline reader: UTF-8 text, a form feed between pages."""

    def read(self, content: bytes, dpi: int = 150, psm: int = 6) -> list[str]:
        return [t.replace("\0", "") for t in content.decode("utf-8", "replace").split("\f")]


def read_pages(files: DataFrame, reader: Ocr, dpi: int = 150, psm: int = 6) -> DataFrame:
    """``path, content`` to ``path, page`` (from 0) and ``text``, a row for each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                texts = with_retry(lambda content=content: reader.read(bytes(content), dpi, psm))
                yield pd.DataFrame({"path": path, "page": range(len(texts)), "text": [t.replace("\0", "") for t in texts]})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def recognise_pages(images: DataFrame, recogniser: Recogniser, prompt: str = prompts.RECOGNISE, attempts: int = 4, sleep: Callable[[float], None] = time.sleep, keep_errors: bool = False) -> DataFrame:
    """``source_key, language, page, content`` to the same with ``blocks``, as the blocks' builder takes them.

    A reply without blocks is an error and asked for again; the last error is raised, and the task with it.  ``keep_errors``:
    it stands in a column ``error`` instead, which is null for pages that were recognised.
    """

    def one(image: bytes) -> str:
        got = recogniser.recognise(image, prompt, prompts.PAGE_SCHEMA)
        if not got.get("blocks"):
            raise ValueError("a page without blocks")
        return json.dumps(got["blocks"])

    def kept(image: bytes) -> tuple[str | None, str | None]:
        try:
            return with_retry(lambda: one(image), attempts, sleep=sleep), None
        except Exception as e:  # noqa: BLE001  whatever a model may raise
            if not keep_errors:
                raise
            return None, f"{type(e).__name__}: {e}"[:300]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [kept(bytes(c)) for c in f["content"]]
            yield f[["source_key", "language", "page"]].assign(blocks=[b for b, _ in got], error=[e for _, e in got])

    found = images.select("source_key", "language", F.col("page").cast("int").alias("page"), "content").mapInPandas(run, "source_key string, language string, page int, blocks string, error string")
    found = found.withColumn("blocks", F.from_json("blocks", prompts.PAGE_BLOCKS))
    return found if keep_errors else found.drop("error")


@dataclass(frozen=True)
class LineRecogniser:
    """The offline recogniser: a page is UTF-8 text, each line a paragraph, its words side by side in a grid."""

    def recognise(self, image: bytes, prompt: str, schema: dict) -> dict:
        lines = [line.split() for line in image.decode("utf-8", "replace").replace("\0", "").splitlines()]
        lines = [words for words in lines if words]
        step = 1000 // max(len(lines), 1)
        blocks = []
        for y, words in enumerate(lines):
            wide = 1000 // len(words) or 1
            boxes = [[y * step, min(x * wide, 999), y * step + step, min(x * wide + wide, 1000)] for x in range(len(words))]
            blocks.append({"block_id": f"l{y + 1}", "type": "paragraph", "box": [y * step, 0, y * step + step, 1000], "words": [{"t": w, "box": b} for w, b in zip(words, boxes, strict=True)]})
        return {"blocks": blocks}


def echo(payload: dict) -> dict:
    """The offline translator: each text as it came."""
    return {"translations": [{"id": b["id"], "text": b["text"]} for b in payload["blocks"]]}


#: Models by name, as jobs name them; what is added here is known to all commands.
RECOGNISERS: dict[str, Callable[[], Recogniser]] = {"offline": LineRecogniser}
TRANSLATORS: dict[str, Callable[[dict], dict]] = {"offline": echo}
OCR: dict[str, Callable[[], Ocr]] = {"offline": LineOcr}


def by_name(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}: one of {', '.join(sorted(registry))}")
    return registry[name]
