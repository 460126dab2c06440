"""Filter interaction audit: what each of five filters removes in every order, alone and beside the others.

A document's failures are a mask of five bits.  A table made once says for each of the 32 masks and 120 orders at which step
the document goes; tasks index it, add up removals by part, order and step with ``bincount``, and give one row for each of
their parts and orders.  These partial rows are summed, and all other figures follow from them: a filter's failures are what
it removes where it stands first, its failures of its own what it removes where it stands last.

Filters (``text`` whole, words are runs of bytes other than 0x20 and 0x09-0x0D, case-sensitive, told apart by 64 bits):
A under 50 words; B distinct words under 65 % of words; C letters A-Z over 5 % of code points; D any of ``#$%&*|``; E the
text of a smaller ``doc_id``, told by 128 bits of SHA-256.

Defined cases: a null text counts as empty, and empty texts are equal texts; a null source is the part ``''``; a null id is
smaller than none and fails E never; rows that share id and text are all first copies or none; of several labels of one
document each mark holds if one row has it, a null label marks nothing; very long texts are measured whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_buffers, bounded, hashed_words, pieces, staged, text_bytes

FILTERS = "ABCDE"
ORDERS = tuple(itertools.permutations(range(len(FILTERS))))
NAMES = ["".join(FILTERS[f] for f in order) for order in ORDERS]
KEPT = len(FILTERS)
#: The step (from 0) at which a mask's first failure stands in an order; KEPT: none.
FIRST = np.array([[next((step for step, f in enumerate(order) if mask >> f & 1), KEPT) for order in ORDERS] for mask in range(1 << len(FILTERS))], np.int64)
#: Parts that a task holds sums of before it gives them out.
HELD = 512

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*|"]] = True


def _masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Failures of A to D of each text; E is known after the texts have met."""
    out = np.zeros(len(offsets) - 1, np.int32)
    for a, b in pieces(offsets):
        h, _, _, of = hashed_words(data, offsets[a : b + 1], lower=False)
        chunk, rel = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

        def count(of_bytes: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(of_bytes)))[rel])  # noqa: B023

        words = np.diff(of)
        row = np.repeat(np.arange(b - a), words)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[1:] != row[:-1])  # rows stand in order already
        distinct = np.bincount(row[new], minlength=b - a)
        fails = (words < 50, 100 * distinct < 65 * words, 100 * count(_UPPER[chunk]) > 5 * count((chunk & 0xC0) != 0x80), count(_SYMBOLS[chunk]) > 0)
        for bit, failed in enumerate(fails):
            out[a:b] |= failed.astype(np.int32) << bit
    return out


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask``: the failures of each text by itself (A to D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = _masks(*binary_buffers(batch.column(3)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mask)], names=["doc_id", "part", "digest", "mask"])

    text = text_bytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), text.alias("bytes"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def _removals(rows: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` to a task's sums: ``part, filter_order``, removals at each step (``r``; the last are those kept), of good (``g``) and of toxic (``t``) documents."""
    columns = [f"{kind}{step}" for kind in "rgt" for step in range(KEPT + 1)]

    def given(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.stack(list(sums.values()))  # part, kind, order, step
        n = len(sums)
        parts = pa.array(np.repeat(np.arange(n), len(ORDERS)))
        cells = table.transpose(0, 2, 1, 3).reshape(n * len(ORDERS), len(columns))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()).take(parts), pa.array(NAMES * n), *(pa.array(np.ascontiguousarray(c)) for c in cells.T)], names=["part", "filter_order", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            part, mask = coded.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy()
            n = len(coded.dictionary)
            cell, number = np.unique(part * 32 + mask, return_inverse=True)
            index = ((cell // 32)[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (KEPT + 1) + FIRST[cell % 32]
            new = []
            for weight in (np.ones(len(mask)), batch.column(2).to_numpy(), batch.column(3).to_numpy()):
                times = np.bincount(number, weights=weight, minlength=len(cell))
                new.append(np.bincount(index.ravel(), weights=np.repeat(times, len(ORDERS)), minlength=n * len(ORDERS) * (KEPT + 1)).astype(np.int64))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                own = np.stack([x.reshape(n, len(ORDERS), KEPT + 1)[i] for x in new])
                if name in sums:
                    sums[name] += own
                else:
                    sums[name] = own
                if len(sums) >= HELD:
                    yield given(sums)
                    sums = {}
        if sums:
            yield given(sums)

    schema = "part string, filter_order string, " + ", ".join(f"{c} long" for c in columns)
    return rows.select("part", "mask", "good", "toxic").mapInArrow(run, schema)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows for each part.

    ``shapley`` adds a filter's removals over all orders; a 120th of it is its Shapley value.
    """
    bounded(spark)
    rows = staged(spark, failures(docs), "failures")
    # written, so that Spark can split the rows of one text, however many copies there are
    copies = staged(spark, rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "copies")
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    known = rows.join(marks, "doc_id", "left").join(copies, "digest", "left")
    known = known.select("part", F.col("mask").bitwiseOR(F.shiftleft(repeats, FILTERS.index("E"))).alias("mask"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    partial = _removals(known)
    sums = partial.groupBy("part", "filter_order").agg(*[F.sum(c).alias(c) for c in partial.columns[2:]])
    each = F.posexplode(F.array(*[F.struct(*[F.col(f"{kind}{s}").alias(kind) for kind in "rgt"], sum((F.col(f"r{x}") for x in range(s + 1, KEPT + 1)), F.lit(0)).alias("kept")) for s in range(KEPT)]))
    steps = sums.select("part", "filter_order", each.alias("at", "x")).select("part", "filter_order", (F.col("at") + 1).alias("step"), "x.*")
    filtered = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("r"))).over(filtered)
    return steps.select("part", "filter_order", "step", "kept", F.col("r").alias("removed"), (at(1) - F.col("r")).alias("redundant"), at(KEPT).alias("unique_fails"), F.col("g").alias("good_lost"), F.col("t").alias("toxic_lost"), F.sum("r").over(filtered).alias("shapley"))
