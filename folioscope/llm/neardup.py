"""Near duplicates by a chosen-path similarity join over shingle sets.

A text's set has its distinct ``k``-word shingles (A-Z lower-cased); a text of fewer words has its whole sequence as
its one shingle; a text without words has none and is linked with nothing.  Two texts are linked when
``100 * intersection >= percent * union``.

A forest of random trees finds most links first.  A node of a tree is the texts whose minwise tokens agree at some chosen
coordinates.  Nodes of at most ``leaf`` texts are compared exhaustively, by sketches; of a larger node, texts whose sketch is
near that of the node's least text are candidates with it and go no further, the others branch: each goes to one or two
children (1 / similarity on average), named by its minwise token at a coordinate that the node chooses.  A round makes
``levels`` levels at once, or twice as many of a very large node.  Candidates are confirmed on the full sets.

What the forest leaves open, large nodes at its end among it, is then joined exactly, so that no link between texts of
different components is lost, whatever ``trees``, ``depth`` and ``leaf`` are.  Shingles have an order, the same for all
texts, with those that are frequent in a sample last; two texts that are linked share one of the first
``n - ceil(percent * n / 100) + 1`` shingles of each.  Texts that share one are a posting.  A posting whose texts stand in one
component has no link to give; of equal postings one is taken.  In the others, texts of different components are compared
by bitmaps, whose distance is never greater than that of the sets, then on the full sets: pairs of postings up to ``leaf``
texts are listed once, larger postings are dealt into blocks of bounded size and compared block by block, no pair listed.
Where a large posting has many components this work grows with its square, in bounded memory, dealt over tasks.

Texts with equal sets stand as one from the start: copies, thousands or more, are never paired.  Pairs are of texts
with different sets only.

Defined cases: null texts are empty; a null id comes back with a null component and is kept, and is never linked; rows
that share an id are one node; very long texts are hashed as a whole; texts that tie in everything but the id fall to the
least id; an empty table gives an empty result; other columns are ignored by ``near_duplicates`` and come back from
``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_buffers, carried, drop_staged, hashed_words, mix, pieces, staged, text_bytes, tidied, windows
from .components import components

COORDINATES = 96
_RNG = np.random.Generator(np.random.PCG64(20250102))
_XOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
SAMPLE, FREQUENT = 4096, 1 << 16  # texts that are looked at for frequent shingles, and how many of these are kept: they order shingles, no result depends on them
BITS = 2048


@dataclass(frozen=True)
class Join:
    """How near duplicates are found; ``k`` and ``percent`` define them, the rest sets what the forest finds and what is left to the exact join."""

    k: int = 5
    percent: int = 80
    trees: int = 6
    leaf: int = 48
    depth: int = 6  # levels of branching
    levels: int = 2  # of a round; twice as many in nodes of more than leaf * leaf texts
    slack: float = 0.2  # five standard deviations of a sketch's estimate at 0.8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for a, b in pieces(offsets):
        h, _, _, of = hashed_words(data, offsets[a : b + 1])
        for i in range(b - a):
            w = h[of[i] : of[i + 1]]
            if len(w) >= k:
                s = np.sort(windows(w, k))
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif len(w):
                yield mix(windows(w, len(w)) + np.uint64(len(w)))
            else:
                yield w


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise token at each coordinate: the least of the set's values under that coordinate's permutation."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, ((low[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=out)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that occur most often in about ``SAMPLE`` texts, ``FREQUENT`` at most, the rarer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(list(shingle_sets(*binary_buffers(batch.column(0)), k))))], names=["shingle"])

    share = min(1 << 20, -(-SAMPLE * (1 << 20) // max(docs.count(), 1)))
    few = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < share))
    counts = few.select(text_bytes().alias("bytes")).mapInArrow(tidied(run), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow().column(0).to_numpy()
    return np.ascontiguousarray(top[::-1]).view(np.uint64)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first of the set's shingles, of which a set that is linked with it shares one: those that aren't frequent by value, then by ``rank``. ``frequent`` is sorted."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    if not len(frequent):
        return s[:n]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    return np.concatenate((s[~often][:n], s[often][np.argsort(rank[at[often]])]))[:n]


def sketched(docs: DataFrame, how: Join) -> DataFrame:
    """``doc_id, n_shingles, fp1, fp2, sig, prefix, bits``: a set's size, its fingerprint (128 bits), its minwise tokens, its first shingles and its bitmap."""
    order = _frequent(docs, how.k)
    rank = np.argsort(order)
    frequent = order[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, fp, sigs, first, bits = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.uint64), [], [], []
            for i, s in enumerate(shingle_sets(*binary_buffers(batch.column(1)), how.k)):
                n[i] = len(s)
                fp[0, i], fp[1, i] = s.sum(dtype=np.uint64), mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
                sigs.append(signature(s).tobytes() if len(s) else None)
                first.append(prefix(s, frequent, rank, how.percent).tobytes() if len(s) else None)
                bits.append(bitmaps(s, np.array([0, len(s)])).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _signed(fp[0]), _signed(fp[1]), pa.array(sigs, pa.binary()), pa.array(first, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "prefix", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, prefix binary, bits binary")


# ---------------------------------------------------------------- the forest


def _matrix(column) -> np.ndarray:
    data, offsets = binary_buffers(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4").reshape(-1, COORDINATES)


def _children(node: np.ndarray, sig: np.ndarray, which: int) -> np.ndarray:
    """The child of each row's node by the coordinate that the node chooses as its ``which``-th."""
    chosen = (mix(node + np.uint64(0xA5A5 + which)) % np.uint64(COORDINATES)).astype(np.int64)
    token = sig[np.arange(len(node)), chosen].astype(np.uint64)
    return mix(mix(node + np.uint64(which + 1)) ^ (token << np.uint64(7) | chosen.astype(np.uint64)))


def _roots(reps: DataFrame, how: Join) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = batch.column(0).to_numpy(), _matrix(batch.column(1))
            nodes = [_children(np.full(len(ids), t + 1, np.uint64), sig, 0) for t in range(how.trees)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(nodes)), pa.array(np.tile(ids, how.trees))], names=["node", "id"])

    return reps.select("id", "sig").mapInArrow(tidied(run), "node long, id long")


def _branches(members: DataFrame, how: Join) -> DataFrame:
    """``node, id, sig, size, left, a, pivot`` of large nodes to ``a, id`` of texts near the pivot, and ``node, id, left`` of the others' descendants some levels below.

    ``a, pivot``: the node's least id and its minwise tokens. ``left``: levels still to go; what lies between is never written.
    """
    share = np.uint64((100 / how.percent - 1) * 2**32)  # nodes that branch in two

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, sig = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), _matrix(batch.column(2))
            size, left, a = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            near = (sig == _matrix(batch.column(6))).mean(axis=1) >= how.percent / 100
            take = np.minimum(np.where(size > how.leaf**2, 2 * how.levels, how.levels), left)
            row = np.flatnonzero(~near & (take > 0))
            node = node[row]
            for step in range(int(take.max())):
                go = take[row] > step
                on, at = node[go], row[go]
                twice = mix(on + np.uint64(77)) >> np.uint64(32) < share
                node = np.concatenate((node[~go], _children(on, sig[at], 0), _children(on[twice], sig[at[twice]], 1)))
                row = np.concatenate((row[~go], at, at[twice]))
            alike = np.flatnonzero(near & (a != ids))
            none, every = pa.nulls(len(alike)), np.concatenate((row, alike))
            nodes, pivots = pa.concat_arrays([_signed(node), none.cast(pa.int64())]), pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(a[alike])])
            yield pa.RecordBatch.from_arrays([nodes, pa.array(ids[every]), pa.array((left - take)[every].astype(np.int32)), pivots], names=["node", "id", "left", "a"])

    return members.select("node", "id", "sig", "size", "left", "a", "pivot").mapInArrow(tidied(run), "node long, id long, left int, a long")


def _shared(spark: SparkSession, rows: DataFrame, key: str = "node", least: int = 2) -> DataFrame:
    """Rows of keys with ``least`` rows or more, with their number as ``size``, written.

    Sizes are added up before rows move, and stand in a table of their own, so that Spark can split a large key's rows.
    """
    sizes = staged(spark, rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least), "sizes")
    out = staged(spark, rows.join(sizes, key), "shared")
    drop_staged(spark, sizes)
    return out


def _leaf_pairs(leaves: DataFrame, how: Join) -> DataFrame:
    """``members array<struct<id, n, sketch>>`` of leaves, compared exhaustively, to ``a, id``.

    Texts of a leaf that close sketches connect are a group; ``a`` is its least id. No more rows than texts.
    """
    least, ratio = how.percent / 100 - how.slack, how.percent / 100

    def run(batches):
        for batch in batches:
            out = ([], [])
            flat = batch.column(0).flatten()
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            ids, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            data, off = binary_buffers(flat.field(2))
            sk = np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint8).reshape(-1, COORDINATES)
            at = 0
            for g in sizes.tolist():
                x, m, i = sk[at : at + g], n[at : at + g], ids[at : at + g]
                at += g
                close = (x[:, None, :] == x[None, :, :]).mean(axis=2) >= least
                close &= np.minimum(m[:, None], m[None, :]) >= ratio * np.maximum(m[:, None], m[None, :]) - 1e-9
                low = i.copy()  # the least id that each member reaches
                while True:
                    new = np.where(close, low[None, :], low[:, None]).min(axis=1)
                    if (new == low).all():
                        break
                    low = new
                keep = low != i
                for col, v in zip(out, (low, i), strict=True):
                    col.append(v[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names=["a", "id"])

    return leaves.select("members").mapInArrow(tidied(run), "a long, id long")


# ---------------------------------------------------------------- the exact join


def bitmaps(shingles: np.ndarray, offsets: np.ndarray, width: int = BITS) -> np.ndarray:
    """For each set ``width`` bits (a power of two), each the parity of the number of its shingles with that value: two sets' bitmaps differ in no more bits than the sets in shingles."""
    out = []
    for at in range(0, len(offsets) - 1, 512):
        o = offsets[at : at + 513]
        of = np.repeat(np.arange(len(o) - 1), np.diff(o))
        bit = (shingles[o[0] : o[-1]] >> np.uint64(20)).astype(np.int64) & (width - 1)
        odd = np.bincount(of * width + bit, minlength=(len(o) - 1) * width) & 1
        out.append(np.packbits(odd.astype(bool)).reshape(-1, width // 8).view(np.uint64))
    return np.concatenate(out) if out else np.zeros((0, width // 64), np.uint64)


def _may_link(n: np.ndarray, bits: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles may be linked, by their bitmaps; false only where they are not."""
    least = -(-percent * (n + m) // (100 + percent))  # shingles that they have to share
    return (least <= np.minimum(n, m)) & (np.bitwise_count(bits ^ other).sum(axis=-1, dtype=np.int64) <= n + m - 2 * least)


def _tokens(reps: DataFrame) -> DataFrame:
    """``token, id``: a row for each shingle of a prefix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data, off = binary_buffers(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data[off[0] : off[-1]].tobytes(), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(off) // 8))], names=["token", "id"])

    return reps.select("id", "prefix").mapInArrow(tidied(run), "token long, id long")


def _posting_pairs(postings: DataFrame, how: Join) -> DataFrame:
    """``members array<struct<id, c, n, bits>>`` of postings up to ``leaf`` texts to ``a, b`` of different components that their bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            flat = batch.column(0).flatten()
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            ids, c, n = (flat.field(f).to_numpy() for f in range(3))
            data, off = binary_buffers(flat.field(3))
            bits = np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64).reshape(-1, BITS // 64)
            at = 0
            for g in sizes.tolist():
                i, j = np.triu_indices(g, 1)
                i, j = i + at, j + at
                at += g
                apart = c[i] != c[j]
                i, j = i[apart], j[apart]
                maybe = _may_link(n[i], bits[i], n[j], bits[j], how.percent)
                a.append(np.minimum(ids[i[maybe]], ids[j[maybe]]))
                b.append(np.maximum(ids[i[maybe]], ids[j[maybe]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return postings.select("members").mapInArrow(tidied(run), "a long, b long")


def _blocks(rows: DataFrame, cost, *fields: str) -> DataFrame:
    """``token, left, right``: each token's rows, arrays of structs of about 4 MB, and each pair of a token's arrays (no right: left with itself)."""
    weight = rows.groupBy("token").agg(F.ceil(F.sum(cost) / (1 << 22)).cast("long").alias("blocks"))
    dealt = rows.join(weight, "token").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    block = dealt.groupBy("token", "at").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct(*fields)).alias("left"))
    alone = block.withColumn("right", F.lit(None).cast(block.schema["left"].dataType)).select("token", "left", "right")
    many = block.filter("blocks > 1")
    return alone.unionByName(many.join(many.select("token", F.col("at").alias("to"), F.col("left").alias("right")), "token").filter("at < to").select("token", "left", "right"))


def _rivals(ci, n, bits, cj, m, other, alone: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text of one side with those of the other side, of other components, that bitmaps don't rule out."""
    c, count = np.unique(np.concatenate((ci, cj)), return_counts=True)
    largest = c[count.argmax()]  # each pair of components has one outside the largest
    outside = np.flatnonzero(cj != largest)
    for r in np.flatnonzero(ci != largest) if alone or not len(outside) else range(len(ci)):
        to = outside if ci[r] == largest else np.flatnonzero(cj != ci[r])
        to = to[_may_link(n[r], bits[r], m[to], other[to], percent)]
        if len(to):
            yield r, to


def _block_rivals(blocks: DataFrame, how: Join) -> DataFrame:
    """``token, left, right`` (arrays of ``struct<id, c, n, bits>``) to the texts of different components that bitmaps don't rule out.

    Where these are at most four pairs a text, they are listed: ``a, b``; where they are more: ``token, id`` of each such text.
    """

    def side(structs):
        data, off = binary_buffers(structs.field(3))
        return (*(structs.field(f).to_numpy() for f in range(3)), np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64).reshape(-1, BITS // 64))

    def run(batches):
        for batch in batches:
            out = {"token": [], "id": [], "a": [], "b": []}

            def put(n, **values):
                for name, col in out.items():
                    col.append(pa.array(values[name], pa.int64()) if name in values else pa.nulls(n, pa.int64()))

            for row in range(batch.num_rows):
                i, ci, n, bits = side(batch.column(1)[row].values)
                alone = not batch.column(2)[row].is_valid
                j, cj, m, other = (i, ci, n, bits) if alone else side(batch.column(2)[row].values)
                x, y, a, b, count, most = np.zeros(len(i), bool), np.zeros(len(j), bool), [], [], 0, 4 * (len(i) + len(j))
                for r, to in _rivals(ci, n, bits, cj, m, other, alone, how.percent):
                    x[r] = y[to] = True
                    count += len(to)
                    if count <= most:
                        a.append(np.minimum(i[r], j[to]))
                        b.append(np.maximum(i[r], j[to]))
                if count > most:
                    found = np.unique(np.concatenate((i[x], j[y])))
                    put(len(found), token=np.full(len(found), batch.column(0)[row].as_py(), np.int64), id=found)
                elif count:
                    put(count, a=np.concatenate(a), b=np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) if c else pa.nulls(0, pa.int64()) for c in out.values()], names=list(out))

    return blocks.mapInArrow(tidied(run), "token long, id long, a long, b long")


def _block_links(blocks: DataFrame, how: Join) -> DataFrame:
    """``left, right`` (arrays of ``struct<id, c, shingles>``) to the links between them, on the full sets.

    Of a text's links to one component one is enough, and those within its own component aren't looked for.
    """

    def side(structs):
        data, off = binary_buffers(structs.field(2))
        shingles, off = np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64), (off - off[0]) // 8
        return structs.field(0).to_numpy(), structs.field(1).to_numpy(), shingles, off, np.diff(off), bitmaps(shingles, off)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                i, ci, x, xo, n, bits = side(batch.column(0)[row].values)
                alone = not batch.column(1)[row].is_valid
                j, cj, y, yo, m, other = (i, ci, x, xo, n, bits) if alone else side(batch.column(1)[row].values)
                for r, to in _rivals(ci, n, bits, cj, m, other, alone, how.percent):
                    own, of = x[xo[r] : xo[r + 1]], np.repeat(np.arange(len(to)), m[to])
                    theirs = np.concatenate([y[yo[q] : yo[q + 1]] for q in to])
                    same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                    common = np.bincount(of[same], minlength=len(to))
                    linked = to[100 * common >= how.percent * (n[r] + m[to] - common)]
                    found = j[linked[np.unique(cj[linked], return_index=True)[1]]]
                    a.append(np.minimum(found, i[r]))
                    b.append(np.maximum(found, i[r]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (a, b)], names=["a", "b"])

    return blocks.select("left", "right").mapInArrow(tidied(run), "a long, b long")


# ---------------------------------------------------------------- confirming


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, shingles, wide`` of the texts whose ids are asked for; ``wide``: a bitmap of at least two bits a shingle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sets = list(shingle_sets(*binary_buffers(batch.column(1)), k))
                wide = [bitmaps(s, np.array([0, len(s)]), max(512, 1 << (2 * len(s)).bit_length())).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(wide, pa.binary())], names=["id", "shingles", "wide"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("bytes"))
    wanted = _likely(rows, ids, "id").join(ids, "id", "left_semi")  # texts move only if their id may be wanted
    return wanted.dropDuplicates(["id", "bytes"]).mapInArrow(tidied(run), "id long, shingles binary, wide binary")


def _likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the wanted, by a Bloom filter of 2^23 bits, 2^17 rows at most."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 23))
    bits = wanted.groupBy(F.shiftright(h, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")).alias("mask"))
    likely = (F.shiftright(h, 6) == F.col("word")) & F.expr(f"mask & shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int)) <> 0")
    return rows.join(F.broadcast(bits), likely, "left_semi")


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _possible(pairs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The pairs that wide bitmaps don't rule out: sets, which are much larger, don't move for the others."""
    n = (F.length("shingles") / 8).cast("long")
    a, b = sets.select(F.col("id").alias("a"), n.alias("n"), F.col("wide").alias("x")), sets.select(F.col("id").alias("b"), n.alias("m"), F.col("wide").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(s), len(t))
                keep.append(bool(_may_link(np.int64(n), _folded(s, words), np.int64(m), _folded(t, words), how.percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(tidied(run), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The pairs that the full sets confirm."""
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((s, t)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= how.percent * (len(s) + len(t) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


# ---------------------------------------------------------------- the whole


def near_duplicates(spark: SparkSession, docs: DataFrame, how: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    ``component_id`` is the least id that links reach; ``kept`` says whether that is the row's own.
    """
    sketches = staged(spark, sketched(docs, how), "sketches")
    full = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = staged(spark, full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")).select("id", F.col("n_shingles").alias("n"), "sig", "prefix", "bits", "fp1", "fp2"), "reps")
    pairs = _candidates(spark, reps.select("id", "n", "sig"), how)
    known = _linked(spark, docs, pairs, how)
    found = _rest(spark, docs, reps.select("id", "n", "prefix", "bits"), known, how)
    drop_staged(spark, pairs, known)
    named = staged(spark, reps.select("fp1", "fp2", F.col("n").alias("n_shingles"), "id").join(found, "id", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "id").alias("component_id")), "named")
    drop_staged(spark, reps, found)
    out = sketches.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    result._folioscope_reads = (sketches, named)  # for callers that write the result and need these no more
    return result


def _candidates(spark: SparkSession, reps: DataFrame, how: Join) -> DataFrame:
    """The forest: ``a, id`` of texts that a leaf holds together, and of texts near the least of a large node, that may be similar enough."""
    levels, leaves, stars = [], [], []
    level = _shared(spark, _roots(reps, how).withColumn("left", F.lit(how.depth)))
    while True:
        levels.append(level)
        leaves.append(level.filter(F.col("size") <= how.leaf).select("node", "id"))
        rest = level.filter(F.col("size") > how.leaf)
        if rest.isEmpty():
            break
        least = rest.groupBy("node").agg(F.min("id").alias("a"))
        pivots = staged(spark, least.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("pivot")), "a").dropDuplicates(["node"]), "pivots")
        below = staged(spark, _branches(rest.join(reps, "id").join(pivots, "node"), how), "below")
        levels += [pivots, below]
        stars.append(below.filter("a IS NOT NULL").select("a", "id"))
        level = _shared(spark, below.filter("node IS NOT NULL").select("node", "id", "left"))
    small = leaves[0]
    for x in leaves[1:]:
        small = small.unionByName(x)
    near = _leaf_pairs(small.join(_with_sketch(reps), "id").groupBy("node").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("members")), how)
    for x in stars:
        near = near.unionByName(x)
    pairs = staged(spark, near.groupBy("id").agg(F.min("a").alias("a")).select("a", "id"), "pairs")
    drop_staged(spark, *levels)
    return pairs


def _linked(spark: SparkSession, docs: DataFrame, pairs: DataFrame, how: Join) -> DataFrame:
    """``id, component`` by the candidates that the full sets confirm."""
    sets = staged(spark, _sets_of(docs, pairs.select("id").unionByName(pairs.select(F.col("a").alias("id"))).distinct(), how.k), "sets")
    links = staged(spark, _confirmed(pairs.select("a", F.col("id").alias("b")), sets, how), "links")
    known = components(spark, links)
    drop_staged(spark, sets, links)
    return known


def _rest(spark: SparkSession, docs: DataFrame, reps: DataFrame, known: DataFrame, how: Join) -> DataFrame:
    """``id, component`` by all links: those between texts of different components in ``known`` are looked for in all postings of shingles."""
    rows = _tokens(reps)
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("name"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 30)).alias("total")).filter("size > 1")
    kept = staged(spark, sizes.groupBy("size", "name", "total").agg(F.min("token").alias("token")).select("token", "size"), "sizes")  # one of those with the same texts
    postings = _likely(rows, kept, "token").join(kept, "token").join(known, "id", "left").select("token", "id", "size", F.coalesce("component", "id").alias("c"))
    postings = staged(spark, postings, "postings")
    mixed = postings.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    members = staged(spark, postings.join(mixed, "token", "left_semi").join(reps.select("id", "n", "bits"), "id"), "members")
    # up to a leaf's texts: pairs, each once
    small = members.filter(F.col("size") <= how.leaf).groupBy("token").agg(F.collect_list(F.struct("id", "c", "n", "bits")).alias("members"))
    # more: text by text, in blocks of bounded size; pairs where bitmaps leave few, else blocks again, on the full sets
    rivals = staged(spark, _block_rivals(_blocks(members.filter(F.col("size") > how.leaf), F.lit(BITS // 8 + 24), "id", "c", "n", "bits"), how), "rivals")
    pairs = staged(spark, _posting_pairs(small, how).unionByName(rivals.filter("a IS NOT NULL").select("a", "b")).distinct(), "pairs")
    many = rivals.filter("token IS NOT NULL").select("token", "id").distinct().join(members.select("token", "id", "c").distinct(), ["token", "id"])
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(many.select("id"))
    sets = staged(spark, _sets_of(docs, asked.distinct(), how.k), "sets")
    large = staged(spark, many.join(sets.select("id", "shingles"), "id"), "large")
    blocks = _blocks(large, F.length("shingles"), "id", "c", "shingles")
    possible = staged(spark, _possible(pairs, sets, how), "possible")
    links = staged(spark, _confirmed(possible, sets, how).unionByName(_block_links(blocks, how)), "links")
    found = components(spark, links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    drop_staged(spark, kept, postings, members, rivals, sets, pairs, possible, large, links)
    return found


def _with_sketch(reps: DataFrame) -> DataFrame:
    """``id, n, sketch``: a byte of each minwise token."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                low = (_matrix(batch.column(2)) >> np.uint32(13)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in low], pa.binary())], names=["id", "n", "sketch"])

    return reps.select("id", "n", "sig").mapInArrow(tidied(run), "id long, n long, sketch binary")


def deduplicated(spark: SparkSession, docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the text with the least id, and texts linked with nothing."""
    found = near_duplicates(spark, docs, how)
    gone = staged(spark, found.filter("NOT kept").select("doc_id").distinct(), "gone")
    drop_staged(spark, *found._folioscope_reads)
    rows = carried(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
