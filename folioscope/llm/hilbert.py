"""Nearest neighbours by largest inner product, over shifted space-filling curves.

Vectors are projected to a few dimensions, in which a sample spreads widely, shifted, and ordered along a Hilbert curve;
several projections and shifts give several orders.  Spark deals each order by range of key, and prefix sums cut it into
runs of ``run`` vectors.  A query goes to its own run and to those within ``window / 2`` vectors to either side; a run and
its queries are compared as matrices, each run gives a query's best, and all lists merge, each vector once.

Of equal vectors only the ``top + 1`` with the least ids can be among anyone's nearest, so no others are candidates.
Products of a block may differ from exact scores in the last bits; all that may be among the best by then are kept, and
scored anew on the original vectors.

``window`` is the least.  Where it doesn't hold all vectors, a bounded sample of queries is compared with all vectors,
and windows grow until the sample finds ``recall`` of its true nearest (less two standard errors).  Windows grow by wider
runs, compared piece by piece, so movement still grows with the number of vectors.  So does work where vectors lie in
clusters.  Where they have no structure (every direction spreads alike), the nearest of a query lie almost anywhere along
a curve; windows that would meet more than the table are replaced by one order compared as a whole, which is exact, and
whose work grows with queries times vectors.  Recall is measured against brute force in the tests.

Defined cases: vectors that are null, zero, or hold nulls or numbers that aren't finite take no part; nor do those whose
length isn't the commonest; equal scores stand in order of id; rows that share an id are one candidate by their best
score; a null id takes no part; fewer candidates than ``top`` give all; equal vectors, however many, are found by their
least ids; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, partitions, staged

BITS = 8
EPSILON = 1e-9  # relative; products of a block are much closer to exact scores
WHOLE = 24  # parts of an order that is compared as a whole
ASKED = 2048  # queries compared at once where windows have grown


@dataclass(frozen=True)
class Curves:
    orders: int = 5
    dims: int = 3
    window: int = 2048
    run: int = 1024
    sample: int = 20_000  # vectors from which the cells' bounds are fitted
    seed: int = 11
    recall: float = 0.9  # what windows grow to reach
    probes: int = 256  # queries on which recall is measured


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along a Hilbert curve of points with whole coordinates in [0, 2^bits): one row of ``points`` each.

    Skilling's transform of all points at once.
    """
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            has = (x[i] & bit) != 0
            t = np.where(has, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(has, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros(len(points), np.uint64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | ((x[i] ^ t) >> np.uint64(b) & np.uint64(1))
    return key.astype(np.int64)


class Frame:
    """One order: directions, and for each the bounds that spread a sample evenly over the curve's cells, shifted.

    Directions are drawn at random and turned to where the sample varies most.
    """

    def __init__(self, sample: np.ndarray, dims: int, rng: np.random.Generator):
        d = sample.shape[1]
        spread = np.cov(sample, rowvar=False).reshape(d, d) if len(sample) > 1 else np.eye(d)
        drawn = rng.normal(size=(d, min(d, dims)))
        self.axes = np.linalg.qr(spread @ drawn + 1e-6 * max(np.trace(spread), 1e-300) * drawn)[0]
        self.shift = rng.uniform(0, 0.5, self.axes.shape[1])
        y = np.sort(sample @ self.axes, axis=0)
        self.bounds = [np.unique(y[np.linspace(0, len(y) - 1, 256).astype(int), i]) for i in range(y.shape[1])]

    def keys(self, v: np.ndarray) -> np.ndarray:
        y = v @ self.axes
        cells = [np.searchsorted(b, y[:, i]) / (len(b) + 1) for i, b in enumerate(self.bounds)]
        shifted = [(c * 0.5 + s) * (1 << BITS) for c, s in zip(cells, self.shift, strict=True)]
        return hilbert_keys(np.clip(np.stack(shifted, 1), 0, (1 << BITS) - 1).astype(np.int64))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.filter(sound).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).select("d")
    return rows.join(F.broadcast(common), F.size("v") == F.col("d"), "left_semi")


def _stack(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(spark: SparkSession, vectors: DataFrame, is_query, top: int = 20, how: Curves = Curves(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` (a Column over ``vec_id``) holds, its ``top`` nearest others found."""
    rows = staged(spark, _candidates(usable(vectors, id_column, vector), is_query, top), "vectors")
    spread = F.xxhash64("vec_id", F.lit(how.seed))
    sample = rows.orderBy(spread, "vec_id").limit(how.sample).toArrow()  # a bounded sample
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    seen = _stack(sample["v"].combine_chunks())
    rng = np.random.default_rng(how.seed)
    frames = [Frame(seen, how.dims, rng) for _ in range(how.orders)]
    curves = staged(spark, _placed(rows, frames, max(partitions(spark), 1)), "curves")
    placed = _in_runs(spark, curves, how.run)
    drop_staged(spark, curves)
    runs = -(-total // how.run)
    side = -(-how.window // (2 * how.run))
    reach = side if 2 * side + 1 >= runs else _reach(rows, placed, is_query, top, how, runs, side)
    grown, wide = reach > side, 1  # runs side by side that count as one
    if grown and how.orders * (2 * reach + 1) >= runs:
        placed, wide, side = placed.filter("ord = 0"), -(-runs // WHOLE), runs
    elif grown:
        side = max(side, 1)
        wide = -(-reach // side)
    n = -(-runs // wide)
    # at the ends of an order the window moves inwards
    width = min(n, 2 * side + 1)
    own = F.floor(F.col("run") / wide).cast("int")
    block = placed.filter("candidate").groupBy("ord", "run").agg(F.collect_list(F.struct("vec_id", "v")).alias("c")).select("ord", own.alias("at"), "c")
    queries = placed.filter(is_query)
    lists = max(1, -(-queries.filter("ord = 0").count() * width // (n * ASKED))) if grown else 1
    low = F.greatest(F.lit(0), F.least(own - side, F.lit(n - width)))
    asked = queries.withColumn("at", F.explode(F.sequence(low, low + width - 1))).groupBy("ord", "at", F.pmod(F.xxhash64("vec_id"), F.lit(lists)).alias("list")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = None, None  # the list of queries at hand, and the best scores of each so far
        for batch in batches:
            for r in range(batch.num_rows):
                (qi, q), (ci, c) = (_members(batch.column(j)[r].values) for j in (0, 1))
                s = q @ c.T
                s[qi[:, None] == ci[None, :]] = -np.inf
                k = min(top, len(ci))
                best = -np.partition(-s, k - 1, axis=1)[:, :k]
                # the blocks of one order share no vector; other orders bring the same again
                order = batch.column(2)[r].as_py()
                if grown and seen is not None and seen[0] == order and np.array_equal(seen[1], qi):
                    best = np.concatenate([held, best], 1)
                    best = -np.partition(-best, min(top, best.shape[1]) - 1, axis=1)[:, :top]
                seen, held = (order, qi), best
                a, b = _may_matter(s, ci, best.min(axis=1), top)
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ci[b]), pa.array(s[a, b])], names=["query_id", "vec_id", "s"])

    met = asked.join(block, ["ord", "at"]).select("q", "c", "ord").mapInArrow(compare, "query_id long, vec_id long, s double")
    if grown:
        met = staged(spark, met, "met")  # in small batches: a task compares many blocks
    once = met.groupBy("query_id", "vec_id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    last = F.min(F.when(F.col("r") <= top, F.col("s"))).over(Window.partitionBy("query_id"))
    few = once.withColumn("r", F.row_number().over(order)).withColumn("last", last).filter((F.col("r") <= top) | (F.col("s") >= F.col("last") - EPSILON * (F.abs("last") + 1)))
    q, c = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("x")), rows.filter("candidate").select("vec_id", F.col("v").alias("y"))
    exact = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = few.select("query_id", "vec_id").join(q, "query_id").join(c, "vec_id").select("query_id", "vec_id", exact.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _candidates(sound: DataFrame, is_query, top: int) -> DataFrame:
    """``vec_id, v, candidate``: of equal vectors the ``top + 1`` least ids (the query itself may be one), and all queries."""
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = sound.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= top + 1).drop("r")
    late = sound.filter(is_query).join(first.select("vec_id").distinct(), "vec_id", "left_anti")
    return first.withColumn("candidate", F.lit(True)).unionByName(late.withColumn("candidate", F.lit(False)))


def _may_matter(s: np.ndarray, ids: np.ndarray, last: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that may be among each row's best ``top``: those above the last of the best, and of those that can't be told from it the largest and the least ids."""
    band = EPSILON * (np.abs(last) + 1)
    a, b = np.nonzero((s >= (last - band)[:, None]) & np.isfinite(s))
    count = np.bincount(a, minlength=len(s))
    many = np.flatnonzero(count > 2 * top)
    if not len(many):
        return a, b
    keep = np.ones(len(a), bool)
    begin = np.concatenate(([0], np.cumsum(count)))
    for i in many:
        own = np.arange(begin[i], begin[i + 1])
        v = s[i, b[own]]
        unsure = np.flatnonzero(v <= last[i] + band[i])
        keep[own[unsure]] = False
        for order in (np.argsort(-v[unsure], kind="stable"), np.argsort(ids[b[own[unsure]]], kind="stable")):
            keep[own[unsure[order[:top]]]] = True
    return a[keep], b[keep]


def _reach(rows: DataFrame, placed: DataFrame, is_query, top: int, how: Curves, runs: int, least: int) -> int:
    """Runs to either side, ``least`` or more, by which a sample of queries finds ``how.recall`` of its true nearest."""
    asked = rows.filter(is_query).orderBy(F.xxhash64("vec_id", F.lit(how.seed)), "vec_id").limit(how.probes).toArrow()  # a bounded sample
    if not asked.num_rows:
        return least
    qi, first = np.unique(asked["vec_id"].to_numpy(), return_index=True)
    q = _stack(asked["v"].combine_chunks())[first]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(qi), 0), np.int64), np.zeros((len(qi), 0))
        for batch in batches:
            if batch.num_rows:
                ci = batch.column(0).to_numpy()
                s = q @ _stack(batch.column(1)).T
                s[qi[:, None] == ci[None, :]] = -np.inf
                ids, scores = np.concatenate([ids, np.broadcast_to(ci, s.shape)], 1), np.concatenate([scores, s], 1)
                kept = np.argpartition(-scores, min(top, scores.shape[1]) - 1, axis=1)[:, :top]
                ids, scores = np.take_along_axis(ids, kept, 1), np.take_along_axis(scores, kept, 1)
        a, b = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ids[a, b]), pa.array(scores[a, b])], names=["query_id", "vec_id", "s"])

    found = rows.filter("candidate").select("vec_id", "v").mapInArrow(best, "query_id long, vec_id long, s double").groupBy("query_id", "vec_id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    pairs = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("query_id", "vec_id").toPandas()
    ids = np.unique(np.concatenate([qi, pairs["vec_id"].to_numpy(np.int64)]))  # probes times top at most
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(int(i),) for i in ids], "vec_id long"))
    at = placed.join(wanted, "vec_id", "left_semi").groupBy("vec_id", "ord").agg(F.min("run").alias("run")).toPandas()
    place = at.pivot(index="vec_id", columns="ord", values="run")
    a, b = place.loc[pairs["query_id"]].to_numpy(), place.loc[pairs["vec_id"]].to_numpy()
    # straight, or by a window that stands at an end of the order
    end = runs - 1
    need = np.minimum(np.abs(a - b), np.minimum(np.maximum(a, -(-b // 2)), np.maximum(end - a, -(-(end - b) // 2)))).min(axis=1)
    _, of = np.unique(pairs["query_id"].to_numpy(), return_inverse=True)
    each = np.bincount(of)
    for reach in [least, *np.unique(need[(need > least) & (need < runs)]).astype(int).tolist()]:  # as many as pairs, at most
        share = np.bincount(of, weights=need <= reach) / each
        if not len(share) or share.mean() - 2 * share.std() / np.sqrt(len(share)) >= how.recall:
            return reach
    return runs


def _placed(rows: DataFrame, frames: list[Frame], parts: int) -> DataFrame:
    """``ord, part, key, vec_id, v, candidate``: every vector in each order, dealt by range of key and id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _stack(batch.column(1))
                k = np.stack([f.keys(v) for f in frames], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(frames)), pa.array(k.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["vec_id", "v", "candidate", "keys"])

    keyed = rows.select("vec_id", "v", "candidate").mapInArrow(keys, "vec_id long, v array<double>, candidate boolean, keys array<long>")
    out = None
    for o in range(len(frames)):
        dealt = keyed.select("vec_id", "v", "candidate", F.col("keys")[o].alias("key")).repartitionByRange(parts, "key", "vec_id")
        part = dealt.select(F.lit(o).alias("ord"), F.spark_partition_id().alias("part"), "key", "vec_id", "v", "candidate")
        out = part if out is None else out.unionByName(part)
    return out


def _in_runs(spark: SparkSession, placed: DataFrame, size: int) -> DataFrame:
    """``ord, run, vec_id, v, candidate``: places along each order, from the partitions' counts and places within them, cut into runs of one size.

    Equal keys are told apart by id, so a key that many vectors share spans runs.
    """
    earlier = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("ord", "part").agg(F.count(F.lit(1)).alias("n")).select("ord", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("ord", "part").orderBy("key", "vec_id")) - 1
    ranked = placed.withColumn("within", within).join(counts, ["ord", "part"])
    return staged(spark, ranked.select("ord", F.floor((F.col("before") + F.col("within")) / size).cast("int").alias("run"), "vec_id", "v", "candidate"), "runs")


def _members(structs) -> tuple[np.ndarray, np.ndarray]:
    return structs.field(0).to_numpy(), _stack(structs.field(1))
