"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Rows of a conversation in order of turn are fed to the machine; it says whether the order of roles is one that the
template allows, and emits text segments, each with a flag that says whether its tokens count in the loss.  Control
strings inside texts are escaped, so that the output can be read back: ``parse`` gives roles, texts and loss again.

Conversations are streamed: partitions are sorted by conversation and turn, and both the writer and the reader hold one
turn and a state at a time, so a conversation of any length needs no more memory than its longest text.

Defined cases: null texts and roles are empty; an order the machine doesn't allow is formatted all the same and marked
not ``valid``, with the turn at which it went wrong; roles the template doesn't know get its ``other`` marks with the
role's name in them; rows that share conversation and turn are ordered by role and text; null conversation ids are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions


@dataclass(frozen=True)
class Template:
    """``marks``: role to (before, after); ``loss``: roles whose text is learned; ``next``: state to allowed roles.

    ``controls`` are all strings that have a meaning in the output.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str] = ("<<ROLE>>{role}<</ROLE>>", "<<END>>")
    loss: frozenset[str] = frozenset({"assistant"})
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant", "user")

    @property
    def controls(self) -> tuple[str, ...]:
        marks = [m for pair in self.marks.values() for m in pair]
        return tuple(sorted({*marks, "<<ROLE>>", "<</ROLE>>", self.other[1], "<s>", "[INST]"}, key=lambda x: (-len(x), x)))


DEFAULT = Template()


def escape(text: str, template: Template = DEFAULT) -> str:
    """A backslash is doubled; a control string gets a backslash after its first character."""
    text = text.replace("\\", "\\\\")
    return re.sub("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls), lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|)", r"\1", text)


class Machine:
    """The automaton: ``step`` gives the segments of a turn; ``wrong_at`` is the first turn out of order, counted from 0."""

    def __init__(self, template: Template = DEFAULT):
        self.template, self.state, self.turns, self.wrong_at = template, "start", 0, None

    def step(self, role: str, text: str) -> list[tuple[str, bool]]:
        t = self.template
        if role not in t.next.get(self.state, ()) and self.wrong_at is None:
            self.wrong_at = self.turns
        self.state, self.turns = role, self.turns + 1
        before, after = t.marks.get(role) or (t.other[0].replace("{role}", escape(role, t)), t.other[1])
        return [(before, False), (escape(text, t), role in t.loss), (after, False)]

    @property
    def valid(self) -> bool:
        return self.wrong_at is None and self.state in self.template.final


def parse(text: str, template: Template = DEFAULT) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted stretch that holds whole turns."""
    opening = {m[0]: role for role, m in template.marks.items()}
    starts = sorted([*opening, "<<ROLE>>"], key=len, reverse=True)
    at = 0
    while at < len(text):
        mark = next((m for m in starts if text.startswith(m, at)), None)
        if mark is None:
            raise ValueError(f"no turn begins at {at}")
        at += len(mark)
        if mark == "<<ROLE>>":
            end = text.index("<</ROLE>>", at)
            role, at, close = unescape(text[at:end]), end + len("<</ROLE>>"), template.other[1]
        else:
            role, close = opening[mark], template.marks[opening[mark]][1]
        end = text.index(close, at)
        yield role, unescape(text[at:end])
        at = end + len(close)


# ---------------------------------------------------------------- Spark


def formatted(spark: SparkSession, conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row for each turn, in order within partitions: ``conv_id, turn_no, text, segments array<struct<start, length, loss>>, valid``.

    ``start`` and ``length`` count code points of the row's ``text``; texts of a conversation, one after another, are its
    formatted form. ``valid`` says whether the order was right so far.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    dealt = rows.repartition(max(partitions(spark), 1), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    segment = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, conv = None, None
        for batch in batches:
            no, texts, segments, valid = [], [], [], []
            ids = batch.column(0).to_pylist()
            for c, role, body in zip(ids, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if machine is None or c != conv:
                    machine, conv = Machine(template), c
                no.append(machine.turns)
                at, spans, out = 0, [], []
                for piece, loss in machine.step(role, body):
                    spans.append({"start": at, "length": len(piece), "loss": loss})
                    at += len(piece)
                    out.append(piece)
                texts.append("".join(out))
                segments.append(spans)
                valid.append(machine.wrong_at is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(no, pa.int64()), pa.array(texts, pa.string()), pa.array(segments, segment), pa.array(valid, pa.bool_())], names=["conv_id", "turn_no", "text", "segments", "valid"])

    return dealt.mapInArrow(run, "conv_id long, turn_no long, text string, segments array<struct<start:int,length:int,loss:boolean>>, valid boolean")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Reads :func:`formatted`'s rows back, in their order: what each conversation holds, from its formatted text and loss flags alone."""
    final = set(template.final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def close(s):
            done.append((s["conv"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["valid"] and s["role"] in final))

        for batch in batches:
            for conv, no, text, spans, valid in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or no == 0:
                    if state is not None:
                        close(state)
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "role": ""}
                for role, body in parse(text, template):
                    state["turns"].update(f"{role}\n{body}\n".encode())
                    state["n"] += 1
                    state["role"] = role
                for s in spans:
                    if s["loss"]:
                        learned = unescape(text[s["start"] : s["start"] + s["length"]])
                        state["loss"].update(learned.encode())
                        state["loss_chars"] += len(learned)
                state["chars"] += len(text)
                state["valid"] &= valid
            yield _digests(done)
            done = []
        if state is not None:
            close(state)
        yield _digests(done)

    return turns.mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
