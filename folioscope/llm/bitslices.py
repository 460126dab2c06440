"""Ranked lexical search on a bit-sliced impact index.

The index holds blocks of documents.  Each term of a block has a row: how many of the block's documents have it, their
places in the block, and its impacts cut into bit slices, a bitmap for each bit with one place for each of these documents.
A task makes the blocks of its own documents, so building the index shuffles nothing; texts are read once for the counts
that impacts depend on (documents with terms, terms of all) and once for the impacts.

A search takes the rows of the terms asked for and gathers them by block and by batch of items.  There all impacts are
multiplied by their terms' weights in one go, by shifted additions of bitmaps; then the terms of each item are spread over
the block's places and added up by bitwise carry arithmetic, several items side by side in one bitmap.  The best ``top`` of
an item are found from the most significant slice downwards, and the blocks' best are ranked.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.  With N documents that have a
term, L terms in all of them, n terms in a document, df documents with a term and tf occurrences of it in a document::

    weight = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
    impact = (1000000000 * tf) div (1000 * tf + 12 * m),  m = 75 + (25 * n * N) div L

A document's score is the sum of weight * impact over an item's terms, repeats included; scores of 0 are no hits.  In a block,
terms are told apart by 64 bits; between blocks by themselves.

Defined cases: null and empty texts have no terms and are never found, as items they find nothing; items that share an id
are one item with all their terms, a null id too; rows of the corpus that share an id are documents of their own, and a null
id comes last among equal scores; very long texts are taken whole, and a text with more terms than a block may hold stands in
a block alone; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_buffers, bounded, hashed_words, pieces, staged, text_bytes

#: Impacts are below 2 ** 20.
IMPACT_BITS = 20
_BREAKS = np.ones(256, bool)
_BREAKS[ord("0") : ord("9") + 1] = _BREAKS[ord("A") : ord("Z") + 1] = _BREAKS[ord("a") : ord("z") + 1] = False
_BREAKS[128:] = False


@dataclass(frozen=True)
class Layout:
    """Sizes of blocks and batches; they set memory and speed, results don't depend on them."""

    documents: int = 16_384  # of a block; places fit in 16 bits
    postings: int = 2_000_000  # of a block, but for a single document with more
    items: int = 256  # of a batch, on average
    lanes: int = 1 << 18  # places added side by side


def _terms(column) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """A run of rows at a time: the first row, where its rows' terms begin, and hash, first byte and end of each term, with the bytes."""
    data, offsets = binary_buffers(column)
    for a, b in pieces(offsets):
        h, starts, ends, of = hashed_words(data, offsets[a : b + 1], breaks=_BREAKS)
        yield a, of, data[offsets[a] : offsets[b]], h, starts, ends


def _lower(chunk: np.ndarray, start: int, end: int) -> bytes:
    return chunk[start:end].tobytes().lower()  # bytes.lower knows A-Z alone


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and terms of all documents with repeats."""

    def run(batches):
        documents = terms = 0
        for batch in batches:
            for _, of, *_ in _terms(batch.column(0)):
                n = np.diff(of)
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])

    row = docs.select(text_bytes().alias("bytes")).mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


# ---------------------------------------------------------------- bitmaps


def add_into(total: list[np.ndarray], other, shift: int = 0) -> None:
    """Adds bit-sliced numbers, ``other`` moved up by ``shift`` bits, to ``total``: a ripple of full adders over whole bitmaps."""
    carry = None
    at = shift
    for x in other:
        while len(total) <= at:
            total.append(np.zeros_like(x))
        a = total[at]
        both = a ^ x
        if carry is None:
            total[at], carry = both, a & x
        else:
            total[at], carry = both ^ carry, (a & x) | (both & carry)
        at += 1
    while carry is not None and carry.any():
        if len(total) <= at:
            total.append(carry)
            return
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def best(slices: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` greatest numbers above 0 and the numbers, places ascending; of equal numbers the first places.

    Goes down the slices: ``sure`` has the places that are in, ``tied`` those that may still be.
    """
    sure, tied = np.zeros_like(slices[0]), slices[0].copy()
    for s in slices[1:]:
        tied |= s  # numbers above 0
    for s in reversed(slices):
        high = tied & s
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
            continue
        sure |= high
        tied &= ~s
        if n == k:
            tied = np.zeros_like(tied)
            break
    at = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    inside = at(sure)
    places = np.sort(np.concatenate((inside, at(tied)[: k - len(inside)])))
    value = np.zeros(len(places), np.int64)
    for bit, s in enumerate(slices):
        value |= (s.view(np.uint8)[places >> 3] >> (places & 7) & 1).astype(np.int64) << bit
    return places, value


# ---------------------------------------------------------------- the index


def index(spark: SparkSession, docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The index, written: a row for each term of a block, and one without a term that has the block's ids.

    ``block, term, n, places, slices, ids``: ``n`` places of 16 bits, and 20 slices of ``n`` bits, least significant first.
    """
    bounded(spark)
    documents, terms = corpus_counts(docs)

    def block(number: int, held: list, names: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([h[0] for h in held])
        order = pc.sort_indices(ids)  # places ascend with ids, null ids come last
        place = np.empty(len(ids), np.int64)
        place[order.to_numpy()] = np.arange(len(ids))
        before = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
        where = place[np.concatenate([h[1] + at for h, at in zip(held, before, strict=True)])]
        term, tf, n = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + 25 * n * documents // max(terms, 1)))
        by_term = np.lexsort((where, term))
        term, where, impact = term[by_term], where[by_term], impact[by_term]
        starts = np.flatnonzero(np.diff(term, prepend=~term[:1]))
        n = np.diff(np.append(starts, len(term)))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.binary()), pa.array([len(ids)]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([ids.take(order)], pa.list_(pa.int64()))], names=NAMES)
        if not len(n):
            return
        # a term's slices stand one after the other, n bits each, from a whole byte on
        ends = np.cumsum((IMPACT_BITS * n + 7) // 8)
        base = np.repeat(8 * (ends - (IMPACT_BITS * n + 7) // 8) - starts, n) + np.arange(len(term))
        bits, step = np.zeros(8 * int(ends[-1]), np.uint8), np.repeat(n, n)
        for s in range(IMPACT_BITS):
            bits[base + s * step] = impact >> s & 1
        binary = lambda raw, ends: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append([0], ends).astype(np.int32)), pa.py_buffer(raw)])
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), number)), pa.array([names[t] for t in term[starts].tolist()], pa.binary()), pa.array(n), binary(where.astype("<u2"), 2 * np.cumsum(n)), binary(np.packbits(bits, bitorder="little"), ends), pa.nulls(len(n), pa.list_(pa.int64()))],
            names=NAMES,
        )
        for lo in range(0, len(n), 1 << 16):
            yield out.slice(lo, 1 << 16)

    def run(batches):
        first, held, size, postings, made = TaskContext.get().partitionId() << 32, [], 0, 0, 0
        names: dict[int, bytes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, of, chunk, h, starts, ends in _terms(batch.column(1)):
                n = np.diff(of)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, row))
                hs, rs = h[order], row[order]
                new = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])))) if len(hs) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(hs)))
                rows, term = rs[new], hs[new]
                at = 0
                while at < len(n):  # rows in runs that still fit
                    here = np.searchsorted(rows, np.arange(at, len(n) + 1))  # postings before each row
                    fits = min(layout.documents - size, int(np.searchsorted(here - here[0], layout.postings - postings, "right")) - 1)
                    if fits <= 0 and size:
                        yield from block(first + made, held, names)
                        held, size, postings, made, names = [], 0, 0, made + 1, {}
                        continue
                    to = min(at + max(fits, 1), len(n))
                    p = slice(int(here[0]), int(here[to - at]))
                    distinct, one = np.unique(term[p], return_index=True)
                    first_of = order[new[p][one]]
                    for t, lo, hi in zip(distinct.tolist(), starts[first_of].tolist(), ends[first_of].tolist(), strict=True):
                        if t not in names:
                            names[t] = _lower(chunk, lo, hi)
                    held.append((batch.column(0).slice(a + at, to - at), rows[p] - at, term[p], tf[p], n[rows[p]]))
                    size, postings, at = size + to - at, postings + p.stop - p.start, to
        if size:
            yield from block(first + made, held, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    out = staged(spark, rows.mapInArrow(run, "block long, term binary, n long, places binary, slices binary, ids array<long>"), "impacts")
    out._folioscope_documents = documents
    return out


NAMES = ["block", "term", "n", "places", "slices", "ids"]


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, times`` of ``item_id, text``."""

    def run(batches):
        for batch in batches:
            for a, of, chunk, _, starts, ends in _terms(batch.column(1)):
                rows = np.repeat(np.arange(len(of) - 1), np.diff(of)) + a
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([_lower(chunk, s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("bytes"))
    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


# ---------------------------------------------------------------- searching


def _block_hits(left: pa.Table, top: int, lanes: int) -> tuple[list, list, list]:
    """``weight, n, places, slices, askers array<struct<item, times>>`` of a block's terms to items' numbers, places and scores."""
    counts = left.column("n").to_numpy()
    bounds = np.concatenate(([0], np.cumsum(counts)))
    total = int(bounds[-1])
    places = np.frombuffer(b"".join(left.column("places").to_pylist()), "<u2").astype(np.int64)
    size = int(places.max()) + 1
    width = -(-size // 64) * 8  # bytes of an item's lane
    bits = np.zeros((IMPACT_BITS, total), np.uint8)
    for i, raw in enumerate(left.column("slices").to_pylist()):
        own = np.unpackbits(np.frombuffer(raw, np.uint8), count=IMPACT_BITS * counts[i], bitorder="little")
        bits[:, bounds[i] : bounds[i + 1]] = own.reshape(IMPACT_BITS, -1)
    packed = np.packbits(bits, axis=1, bitorder="little")
    del bits
    # weight * impact of all postings at once: where a weight has a bit, its impacts are added, moved up by it
    weights = np.repeat(left.column("weight").to_numpy(), counts)
    product: list[np.ndarray] = []
    for bit in range(int(weights.max()).bit_length()):
        has = np.packbits((weights >> bit & 1).astype(np.uint8), bitorder="little")
        if has.any():
            add_into(product, packed & has, bit)
    if not product:
        return [], [], []  # all weights are 0
    del packed, weights
    # each term's slices as bytes of a block's bitmap, those that aren't 0 only
    run = np.repeat(np.arange(len(counts)) * width, counts) + (places >> 3)
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    of_term = np.searchsorted(starts, bounds)
    byte = (run[starts] % width).astype(np.int64)
    bit_at = (1 << (places & 7)).astype(np.uint8)
    cells = np.stack([np.bitwise_or.reduceat(np.unpackbits(s, count=total, bitorder="little") * bit_at, starts) for s in product])
    # the items' terms, repeats as shifts
    asked: dict[int | None, list[tuple[int, int]]] = {}
    for t, askers in enumerate(left.column("askers").to_pylist()):
        for x in askers:
            for shift in range(x["times"].bit_length()):
                if x["times"] >> shift & 1:
                    asked.setdefault(x["item"], []).append((t, shift))
    items = sorted(asked, key=lambda i: len(asked[i]))  # those with like numbers of terms go side by side
    side = max(1, lanes // (8 * width))
    found: tuple[list, list, list] = [], [], []
    for lo in range(0, len(items), side):
        some = items[lo : lo + side]
        sums: list[np.ndarray] = []
        for step in range(len(asked[some[-1]])):
            by_shift: dict[int, list[tuple[int, int]]] = {}
            for lane, item in enumerate(some):
                if step < len(asked[item]):
                    t, shift = asked[item][step]
                    by_shift.setdefault(shift, []).append((lane, t))
            for shift, terms in by_shift.items():
                spread = np.zeros((len(product), len(some) * width), np.uint8)
                for lane, t in terms:
                    c = slice(of_term[t], of_term[t + 1])
                    spread[:, lane * width + byte[c]] = cells[:, c]
                add_into(sums, spread.view(np.uint64), shift)
        for lane, item in enumerate(some):
            w = slice(lane * width // 8, (lane + 1) * width // 8)
            at, score = best([np.ascontiguousarray(s[w]) for s in sums], top)
            found[0].extend([item] * len(at))
            found[1].append(at)
            found[2].append(score)
    return found


def search(spark: SparkSession, rows: DataFrame, items: DataFrame, top: int = 20, layout: Layout = Layout()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``top`` documents of each item, from the rows of :func:`index`."""
    documents = rows._folioscope_documents
    asked = staged(spark, item_terms(items), "asked")
    batches = max(1, -(-asked.select("item_id").distinct().count() // layout.items))
    postings = rows.filter("term IS NOT NULL")
    met = postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "n")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * documents + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = met.groupBy("term").agg(F.sum("n").alias("df")).select("term", weight.alias("weight")).filter("weight > 0")
    batch = F.pmod(F.xxhash64("item_id"), F.lit(batches)).cast("int")
    wanted = asked.groupBy("term", batch.alias("batch")).agg(F.collect_list(F.struct(F.col("item_id").alias("item"), "times")).alias("askers")).join(weighed, "term")
    left = postings.select("block", "term", "n", "places", "slices").join(wanted, "term").select(F.col("block").alias("own_block"), F.col("batch").alias("own_batch"), "weight", "n", "places", "slices", "askers")
    right = rows.filter("term IS NULL").select(F.col("block").alias("of_block"), "ids", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("of_batch"))
    width, lanes = top, layout.lanes

    def hits(terms: pa.Table, block: pa.Table) -> pa.Table:
        item, place, score = _block_hits(terms, width, lanes) if terms.num_rows else ([], [], [])
        ids = block.column("ids").combine_chunks().flatten()
        at = np.concatenate(place) if place else np.zeros(0, np.int64)
        return pa.table({"item_id": pa.array(item, pa.int64()), "doc_id": ids.take(pa.array(at)), "score": pa.array(np.concatenate(score) if score else at, pa.int64())})

    found = left.groupBy("own_block", "own_batch").cogroup(right.groupBy("of_block", "of_batch")).applyInArrow(hits, "item_id long, doc_id long, score long")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
