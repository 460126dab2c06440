"""Repeated passages by a sparse suffix array.

A window of ``length`` words is repeated if an equal window stands earlier, in order of document id and place.  The words
of repeated windows are a text's repeated passages; first occurrences stay.

1. Anchors: of any ``span`` consecutive word-grams the one with the least hash marks its place, so equal stretches have
   the same anchors.  Only suffixes at anchors are kept, about one in ten.  Each is keyed by the words around the anchor
   that any repeated window holds in full: ``before`` to the left, ``after`` to the right, ``length - span + 1`` in all.
   With it goes its whole context: all words, to either side, that a window about the anchor can reach.
2. The sparse array is sorted over all partitions by (key, context, document, place), and neighbours are compared.  A
   suffix that has its neighbour's whole context is a match, extended to the left and to the right as far as windows
   about its anchor reach: one row.  Others that agree with a neighbour in the key alone remain, as does the first suffix
   of each context.
3. Those that remain are extended left and right, a word at a time: each window about them has a hash of 128 bits; these
   are sorted and neighbours compared in the same way, and all but the first of a run repeat.  Every window's first
   occurrence is at a first suffix of its context, so nothing is lost by step 2.
4. A text's repeated windows unite to spans.

Keys are two independent 64-bit hashes, compared together: about 1e-13 false matches are expected among 1e13 windows.
Whole copies are found by their texts' fingerprints (128 bits) first and take no part in the sort: of equal word
sequences of ``length`` words or more, all but the first are one repeated span.

A run that is longer than a partition goes on in the next: order is by key, document and place, and each partition's
first row is settled against the last row of the partition before, in one task that has two rows for each partition.

Defined cases: null texts have no words; rows with a null id are left as they are and are nobody's source; rows that
share an id and text are one text; rows that share an id but not the text are texts of their own, in order of their
texts' hashes, and spans reach only their own text; texts under ``length`` words have no repeats; very long texts are
searched whole; an empty table gives an empty result; other columns are ignored by ``repeats`` and come back from
``without_repeats``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_buffers, carried, drop_staged, hashed_words, long_windows, mix, partitions, pieces, powers, staged, text_bytes, tidied, windows

LENGTH = 50
GRAM = 5


def _plan(length: int) -> tuple[int, int, int]:
    """``span, before, after`` for a window length."""
    span = max(1, 2 * length // 5)
    around = length - span + 1
    before = max(0, (around - GRAM) // 2)
    return span, before, around - before


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """Places of the word-grams that have the least hash (the first of equals) among some ``span`` consecutive ones."""
    g = windows(h, GRAM)
    n = len(g)
    if n < span:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFF)
    place = np.arange(n, dtype=np.uint64)
    key = g & ~low | place & low  # 40 bits of the hash, then the place: the first of equals is the least
    # least of each stretch: the least from its start to a block's end, and from the next block's start to its end
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(blocks, span)
    down = np.minimum.accumulate(grid, axis=1).reshape(-1)
    up = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(up[: n - span + 1], down[span - 1 : n])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return np.unique(start + ((least[start] - start.astype(np.uint64)) & low).astype(np.int64))


def text_hash(text: str = "text") -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(text_bytes(text))


def _contexts(w: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of all words that windows about each place can reach, and of where the text ends within them."""
    _, before, after = _plan(length)
    lo, hi = np.maximum(at + after - length, 0), np.minimum(at - before + length, len(w))
    power, inverse = powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(mix(w ^ np.uint64(0x5851F42D4C957F2D)) * power[: len(w)], out=sums[1:])
    return mix(mix((sums[hi] - sums[lo]) * inverse[lo]) + (at - lo).astype(np.uint64) * np.uint64(64 * 1024 + 1) + (hi - at).astype(np.uint64))


def _sequences(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, th, n_words, fp1, fp2, keys, contexts, places``: each text's fingerprint as a sequence, and its anchors."""
    span, before, after = _plan(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_buffers(batch.column(2))
            n, fp, keys, contexts, places = [], [], [], [], []
            for a, b in pieces(offsets):
                h, _, _, of = hashed_words(data, offsets[a : b + 1], lower=False)
                for i in range(b - a):
                    w = h[of[i] : of[i + 1]]
                    n.append(len(w))
                    fp.append(_fingerprint(w))
                    at = anchors(w, span) if len(w) >= length else np.zeros(0, np.int64)
                    at = at[(at >= before) & (at + after <= len(w))]
                    keys.append((long_windows(w, before + after)[at - before] if len(at) else np.zeros(0, np.uint64)).tobytes())
                    contexts.append((_contexts(w, at, length) if len(at) else np.zeros(0, np.uint64)).tobytes())
                    places.append(at.astype("<i4").tobytes())
            f = np.asarray(fp, np.uint64).reshape(-1, 2)
            cols = [pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(f[:, j]).view(np.int64)) for j in (0, 1)), *(pa.array(x, pa.binary()) for x in (keys, contexts, places))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "th", "n_words", "fp1", "fp2", "keys", "contexts", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), text_bytes().alias("bytes"))
    return rows.mapInArrow(tidied(run), "doc_id long, th long, n_words long, fp1 long, fp2 long, keys binary, contexts binary, places binary")


def _fingerprint(w: np.ndarray) -> tuple[int, int]:
    place = np.arange(len(w), dtype=np.uint64)
    return int(mix(w + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)), int(mix((w ^ np.uint64(0xABCDEF)) + place * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64))


def _spread(rows: DataFrame) -> DataFrame:
    """``doc_id, th, keys, contexts, places`` to a row for each anchor: ``k1, k2, doc_id, th, at``."""

    def run(batches):
        for batch in batches:
            flat = []
            for j, kind in ((2, np.int64), (3, np.int64), (4, "<i4")):
                data, off = binary_buffers(batch.column(j))
                flat.append(np.frombuffer(data[off[0] : off[-1]].tobytes(), kind))
            each = np.diff(off) // 4
            own = [np.repeat(batch.column(j).to_numpy(), each) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat[0], flat[1], *own, flat[2])], names=["k1", "k2", "doc_id", "th", "at"])

    return rows.select("doc_id", "th", "keys", "contexts", "places").mapInArrow(tidied(run), "k1 long, k2 long, doc_id long, th long, at int")


_ORDER = ("k1", "k2", "doc_id", "th", "at")
_SORTED = "k1 long, k2 long, doc_id long, th long, at int, source long, twin boolean, head boolean, tail boolean, part long"


def _neighbours(spark: SparkSession, rows: DataFrame, near: bool) -> DataFrame:
    """``k1, k2, doc_id, th, at`` sorted over all partitions, each row compared with its neighbours.

    Rows that agree with the one before in both keys are twins, with its document as ``source``; they stay, as do every
    partition's first (``head``) and last (``tail``) row and, for ``near``, all rows that agree with either neighbour in
    the first key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, before, top = None, None, True  # the last row so far, whose twin may come in the next batch; the row before it

        def flagged(cols, before, after, first, last):
            """``cols`` compared with each other and with the rows beyond them, ``before`` and ``after``, or None."""
            prev = [np.concatenate(([b], c[:-1])) for b, c in zip(before or [c[0] for c in cols], cols, strict=True)]
            alike = cols[0] == prev[0]
            alike[0] &= before is not None
            twin = alike & (cols[1] == prev[1]) & ((cols[2] != prev[2]) | (cols[3] != prev[3]) | (cols[4] != prev[4]))  # not the same row twice
            head, tail = np.zeros(len(twin), bool), np.zeros(len(twin), bool)
            head[0], tail[-1] = first, last
            keep = twin | head | tail
            if near:
                keep |= alike
                keep[:-1] |= alike[1:]
                keep[-1] |= after is not None and after[0] == cols[0][-1]
            sel = np.flatnonzero(keep)
            out = [c[sel] for c in (*cols, prev[2], twin, head, tail)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, np.full(len(sel), part, np.int64))], names=["k1", "k2", "doc_id", "th", "at", "source", "twin", "head", "tail", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(j).to_numpy() for j in range(5)]
            if held is not None:
                cols = [np.concatenate(([h], c)) for h, c in zip(held, cols, strict=True)]
            if len(cols[0]) > 1:
                yield flagged([c[:-1] for c in cols], before, [c[-1] for c in cols], top, False)
                before, top = [c[-2] for c in cols], False
            held = [c[-1] for c in cols]
        if held is not None:
            yield flagged([np.asarray([h]) for h in held], before, None, top, True)

    order = rows.repartitionByRange(max(partitions(spark), 1), *_ORDER).sortWithinPartitions(*_ORDER)
    return order.select(*_ORDER).mapInArrow(tidied(run), _SORTED)


def _settled(found: DataFrame) -> DataFrame:
    """``doc_id, th, at, source`` of all rows but the first of each run, with partitions' first rows settled."""
    inner = found.filter("twin").select("doc_id", "th", "at", "source")
    ends = found.filter("head OR tail")  # two rows for each partition at most
    by_part = ends.groupBy("part").agg(*[F.max(F.when(F.col(end), F.col(c))).alias(f"{end}_{c}") for end in ("head", "tail") for c in _ORDER])
    before = Window.orderBy("part")
    heads = by_part.select(*[F.col(f"head_{c}").alias(c) for c in _ORDER], *[F.lag(f"tail_{c}").over(before).alias(f"prev_{c}") for c in _ORDER])
    twin = "k1 = prev_k1 AND k2 = prev_k2 AND (doc_id <> prev_doc_id OR th <> prev_th OR at <> prev_at)"
    return inner.unionByName(heads.filter(twin).select("doc_id", "th", "at", F.col("prev_doc_id").alias("source")))


def _extended(docs: DataFrame, near: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows of ``length`` words about the anchors that remain: ``k1, k2, doc_id, th, at``, each window once."""
    _, before, after = _plan(length)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), text_bytes().alias("bytes"))
    names = ["k1", "k2", "doc_id", "th", "at"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = binary_buffers(batch.column(2))
            places, ids, ths = batch.column(3), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = ([], [], [], [], [])
            for a, b in pieces(offsets):
                h, _, _, of = hashed_words(data, offsets[a : b + 1], lower=False)
                for i in range(b - a):
                    w = h[of[i] : of[i + 1]]
                    at = places[a + i].values.to_numpy()
                    # windows that hold the anchor with its key's words: from at + after - length to at - before
                    n = len(w) - length + 1
                    edge = np.zeros(len(w) + 2, np.int32)
                    np.add.at(edge, np.clip(at + after - length, 0, None), 1)
                    np.add.at(edge, at - before + 1, -1)
                    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                    two = (long_windows(w, length)[starts], long_windows(mix(w ^ np.uint64(0xD1342543DE82EF95)), length)[starts])
                    row = (*(k.view(np.int64) for k in two), np.full(len(starts), ids[a + i]), np.full(len(starts), ths[a + i]), starts.astype(np.int32))
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                if sum(map(len, out[4])) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out = ([], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return own.join(near, ["doc_id", "th"]).select("doc_id", "th", "bytes", "places").mapInArrow(tidied(run), "k1 long, k2 long, doc_id long, th long, at int")


def repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, n_words, source_id, whole``: each repeated span, in words, and a document that has its beginning earlier.

    ``whole``: the text is a copy, word for word, of ``source_id``'s.
    """
    return _repeats(spark, docs, length).select("doc_id", "start", "n_words", "source_id", "whole")


def _repeats(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """:func:`repeats` with ``th``, the text's hash."""
    _, before, after = _plan(length)
    seqs = staged(spark, _sequences(docs, length), "sequences")
    long = seqs.filter((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    firsts = staged(spark, long.groupBy("fp1", "fp2", "n_words").agg(F.min(F.struct("doc_id", "th")).alias("first")), "firsts")
    same = ["fp1", "fp2", "n_words"]
    copies = long.select("doc_id", "th", *same).join(firsts, same).filter("doc_id <> first.doc_id OR th <> first.th")
    copies = copies.select("doc_id", "th", F.lit(0).cast("long").alias("start"), "n_words", F.col("first.doc_id").alias("source_id"), F.lit(True).alias("whole")).distinct()
    copies = staged(spark, copies, "copies")
    one = firsts.select("first.doc_id", "first.th", *same)
    searched = long.filter(F.length("places") > 0).join(one, ["doc_id", "th", *same], "left_semi").dropDuplicates(["doc_id", "th"])
    sorted_ = staged(spark, _neighbours(spark, _spread(searched), near=True), "anchors")
    # matches in the whole context: windows that begin from at + after - length to at - before, within the text
    lo, hi = F.greatest(F.col("at") + after - length, F.lit(0)), F.least(F.col("at") - before, F.col("n_words").cast("int") - length)
    sizes = one.select("doc_id", "th", "n_words")
    matched = sorted_.filter("twin").join(sizes, ["doc_id", "th"]).select("doc_id", "th", lo.alias("lo"), hi.alias("hi"), "source")
    rest = sorted_.filter("NOT twin").groupBy("doc_id", "th").agg(F.collect_set("at").alias("places"))
    windows_ = staged(spark, _neighbours(spark, _extended(docs, rest, length), near=False), "runs")
    repeated = matched.unionByName(_settled(windows_).select("doc_id", "th", F.col("at").alias("lo"), F.col("at").alias("hi"), "source"))
    spans = staged(spark, _spans(repeated, length), "spans")
    drop_staged(spark, sorted_, windows_, seqs, firsts)
    return spans.withColumn("whole", F.lit(False)).unionByName(copies)


def _spans(repeated: DataFrame, length: int) -> DataFrame:
    """Stretches of windows that touch or overlap unite; a text's are no more than its words."""
    w = Window.partitionBy("doc_id", "th").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("lo") > reach + length).cast("int"), F.lit(1))
    groups = repeated.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    ends = [F.min("lo").cast("long").alias("start"), (F.max("hi") - F.min("lo") + length).cast("long").alias("n_words"), F.min_by("source", F.struct("lo", "source")).alias("source_id")]
    return groups.groupBy("doc_id", "th", "g").agg(*ends).drop("g")


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out, and ``n_chars``, where there is one, set right; texts with no word left go."""
    spans = _repeats(spark, docs, length).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("spans"))
    rows = carried(docs, F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th")).join(spans, ["doc_id", "th"], "left")
    changed = F.col("spans").isNotNull()
    text = F.when(changed, _cut(F.col("row")["text"], F.col("spans"))).otherwise(F.col("row")["text"])
    out = rows.select("row", "spans", text.alias("cut")).filter(~changed | F.col("cut").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` (first word and number) and the white space after them."""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for start, n in sorted(spans):
        end = min(start + n, len(words))
        if start >= end:
            continue
        a, b = words[start][0], (words[end][0] if end < len(words) else len(text))
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def _cut_series(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or t is None else cut_words(t, [(x["start"], x["n_words"]) for x in s]) for t, s in zip(texts, all_spans, strict=True)], dtype=object)


def _cut(text, spans):
    return F.pandas_udf(_cut_series, "string")(text, spans)
