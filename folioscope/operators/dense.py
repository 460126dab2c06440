"""Nearest vectors by cosine: the comparison of blocks of vectors with blocks of questions, and an index of inverted lists.

Vectors and questions each have a ``cell``; a question is compared with its cell's vectors, exactly.  Exact search has one
cell; the index has one for each of its lists, and a question asks the lists whose centroids are nearest.

Defined cases: null vectors, vectors of length 0 or with components that are no finite numbers take no part; a question is
compared with vectors of its own number of components only; equal distances stand by ``guid``; null guids come last; an empty
index and no questions give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..plans.session import scratch, written

MAX_ROWS = 50  # no search returns more
SENT = 10_000  # questions that are sent to all tasks; more are dealt to the vectors' blocks by key
SLOT = 65_536  # vectors of a block that questions are dealt to
_NEAR = 1e-12  # what products of one pair may differ by


def sound(vector: Column) -> Column:
    """The vector in double precision, or null where it can't be compared."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & F.exists(v, lambda x: x != 0), v)


# ---------------------------------------------------------------- blocks


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # lengths of very large and very small vectors stay in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lengths(column) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _block_best(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Question, vector and distance of each question's ``k`` nearest of a block; ``order``: where each vector's guid stands.

    A matrix product finds them and all that are within rounding of the last; these alone are computed pair by pair.
    """
    found: tuple[list, list, list] = [], [], []
    step = max(1, (1 << 22) // max(len(v), 1))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        near = part @ v.T
        n = min(k, len(v))
        last = np.partition(near, len(v) - n, axis=1)[:, len(v) - n]
        a, b = np.nonzero(near >= last[:, None] - _NEAR)
        exact = np.empty(len(a))
        for lo in range(0, len(a), 1 << 16):
            hi = lo + (1 << 16)
            exact[lo:hi] = 1.0 - (part[a[lo:hi]] * v[b[lo:hi]]).sum(axis=1)
        exact[np.abs(exact) < 1e-15] = 0.0  # equal directions, but for the last bits
        by = np.lexsort((order[b], exact, a))
        a, b, exact = a[by], b[by], exact[by]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        for column, x in zip(found, (a[keep] + at, b[keep], exact[keep]), strict=True):
            column.append(x)
    return tuple(np.concatenate(c) for c in found)


def _compare(questions: dict[int, tuple[pa.Array, np.ndarray]], guids: pa.Array, vectors: pa.Array, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``questions``: by number of components, ids and unit vectors."""
    sizes = _lengths(vectors)
    for d, (ids, q) in questions.items():
        own = pa.array(sizes == d)
        g, v = guids.filter(own), _rows(vectors.filter(own), d)
        if not len(v) or not len(q):
            continue
        order = np.empty(len(g), np.int64)
        order[pc.sort_indices(g).to_numpy()] = np.arange(len(g))
        a, b, distance = _block_best(q, _unit(v), order, k)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), g.take(pa.array(b)), pa.array(distance)], names=names)


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    sizes = _lengths(vectors)
    out = {}
    for d in np.unique(sizes).tolist():
        own = pa.array(sizes == d)
        out[int(d)] = ids.filter(own), _unit(_rows(vectors.filter(own), int(d)))
    return out


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, guid, cosine_distance, rank``: each question's ``k`` nearest of its cells' vectors.

    ``vectors``: ``cell, guid, embedding``; ``asked``: ``cell, query_id, vector``, once for each cell it asks.  At most SENT
    rows of questions go to all tasks, and vectors don't move.  More are dealt: vectors to slots of their cell, questions to
    each slot of their cells in lots of SENT, so no task holds more than a slot and a lot.
    """
    spark = vectors.sparkSession
    v = vectors.select("cell", "guid", sound(F.col("embedding")).alias("embedding")).filter("embedding IS NOT NULL")
    q = asked.select("cell", "query_id", sound(F.col("vector")).alias("vector")).filter("vector IS NOT NULL")
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("guid", vectors.schema["guid"].dataType), StructField("cosine_distance", DoubleType())])
    names = schema.names
    few = q.limit(SENT + 1).toArrow()
    if few.num_rows <= SENT:
        sent, cells = {}, few.column("cell").combine_chunks()
        for cell in pc.unique(cells).to_pylist():
            own = few.filter(pc.equal(cells, cell)).combine_chunks()
            sent[cell] = _by_length(own.column("query_id").combine_chunks(), own.column("vector").combine_chunks())
        held = spark.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in pc.unique(batch.column(0)).to_pylist():
                    if cell in held.value:
                        own = batch.filter(pc.equal(batch.column(0), cell))
                        yield from _compare(held.value[cell], own.column(1), own.column(2), k, names)

        met = v.filter(F.col("cell").isin(list(sent))).mapInArrow(run, schema) if sent else spark.createDataFrame([], schema)
    else:
        met = _dealt(v, q, k, schema)
    w = Window.partitionBy("query_id").orderBy("cosine_distance", F.asc_nulls_last("guid"))
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dealt(v: DataFrame, q: DataFrame, k: int, schema: StructType) -> DataFrame:
    parts = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    deal = written(parts(v, SLOT, "slots").join(parts(q, SENT, "lots"), "cell"), "deal")
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = v.join(deal, "cell").select(F.col("cell").alias("v_cell"), of("guid", "slots").alias("v_slot"), each("lots").alias("v_lot"), "guid", "embedding")
    right = q.join(deal, "cell").select(F.col("cell").alias("q_cell"), each("slots").alias("q_slot"), of("query_id", "lots").alias("q_lot"), "query_id", "vector")

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and questions.num_rows:
            held = _by_length(questions.column("query_id").combine_chunks(), questions.column("vector").combine_chunks())
            out = list(_compare(held, vectors.column("guid").combine_chunks(), vectors.column("embedding").combine_chunks(), k, schema.names))
        return pa.Table.from_batches(out) if out else pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema})

    return left.groupBy("v_cell", "v_slot", "v_lot").cogroup(right.groupBy("q_cell", "q_slot", "q_lot")).applyInArrow(run, schema)


# ---------------------------------------------------------------- inverted lists


@dataclass(frozen=True)
class Lists:
    """How an index is trained. Centroids are fitted on a bounded sample; every vector is indexed."""

    lists: int | None = None  # None: about the square root of the vectors' number
    most: int = 4096  # lists, so that centroids can be sent to all tasks
    sample: int = 65_536  # vectors that centroids are fitted on, by hash of their guid
    probes: int = 256  # vectors of the sample that recall is measured with
    recall: float = 0.95  # of the nearest ``top``, that a default search aims at
    top: int = 20


def _nearest_lists(centroids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.argmax(_unit(vectors) @ centroids.T, axis=1).astype(np.int32)


def _listed(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``list``, that of the nearest centroid. Vectors of another number of components than the centroids stand in list -1."""
    at, dims = chunks.columns.index("embedding"), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(at)
            own = _lengths(v) == dims
            out = np.full(batch.num_rows, -1, np.int32)
            if own.any():
                out[own] = _nearest_lists(centroids, _rows(v.filter(pa.array(own)), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "list"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("list", IntegerType())]))


def build_index(chunks: DataFrame, folder: str, how: Lists = Lists()) -> str:
    """Writes an index of ``guid, embedding`` (and ``owner``, ``language`` where there are some) to a new folder, and gives it back.

    In it: ``centroids``, ``vectors`` in a folder for each batch and list, ``sizes`` of lists by batch, owner and language, and
    how many lists a search asks by default, from the recall of a sample.
    """
    spark = chunks.sparkSession
    carried = [c for c in ("owner", "language") if c in chunks.columns]
    rows = chunks.select("guid", *carried, sound(F.col("embedding")).alias("embedding")).filter("embedding IS NOT NULL")
    counts = {r["d"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    dims, total = next(iter(counts.items()), (1, 0))
    sampled = rows.filter(F.size("embedding") == dims).filter(F.pmod(F.xxhash64("guid", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, how.sample / max(total, 1)))).select("guid", "embedding")
    n_lists = max(1, min(how.lists or round(total**0.5), how.most, total))
    centroids = _centroids(sampled, n_lists, dims)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{folder}/centroids")
    rows.limit(0).write.parquet(f"{folder}/schema")
    _append(rows, centroids, folder)
    spark.createDataFrame([(_asked_lists(spark, folder, sampled, centroids, how),)], "lists int").write.parquet(f"{folder}/defaults")
    return folder


def _centroids(sampled: DataFrame, n: int, dims: int) -> np.ndarray:
    if n < 2:
        return np.eye(1, dims)
    model = KMeans(k=n, seed=1, maxIter=10, distanceMeasure="cosine", featuresCol="v").fit(sampled.select(array_to_vector("embedding").alias("v")))
    return _unit(np.array(model.clusterCenters()))


def _append(rows: DataFrame, centroids: np.ndarray, folder: str) -> None:
    """Writes a batch of vectors and then its sizes: searches see the batches that have sizes, so one that failed half-way isn't there."""
    batch = uuid.uuid4().hex
    keys = ["list", *[c for c in ("owner", "language") if c in rows.columns]]
    listed = _listed(rows, centroids)
    path = f"{folder}/vectors/batch={batch}"
    listed.hint("rebalance", "list").write.partitionBy("list").parquet(path)
    stored = rows.sparkSession.read.schema(listed.schema).parquet(path)
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(batch))
    sizes.write.mode("append").parquet(f"{folder}/sizes")


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the batches that are there, and their sizes."""
    sizes = spark.read.parquet(f"{folder}/sizes")
    batches = [r["batch"] for r in sizes.select("batch").distinct().collect()]  # a row for each insertion
    schema = spark.read.parquet(f"{folder}/schema").schema.add("list", IntegerType()).add("batch", StringType())
    return spark.read.schema(schema).parquet(f"{folder}/vectors").filter(F.col("batch").isin(batches)), sizes


def insert(chunks: DataFrame, folder: str) -> None:
    """Adds vectors to the lists whose centroids are nearest; nothing is trained anew."""
    spark = chunks.sparkSession
    stored = spark.read.parquet(f"{folder}/schema")
    names = [c for c in ("guid", "owner", "language", "embedding") if c in stored.columns]
    rows = chunks.withColumn("embedding", sound(F.col("embedding"))).filter("embedding IS NOT NULL").select(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in names])
    _append(rows, _stored_centroids(spark, folder), folder)


def _stored_centroids(spark: SparkSession, folder: str) -> np.ndarray:
    return np.array([r["centroid"] for r in spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()])  # Lists.most rows at most


def _asked_lists(spark: SparkSession, folder: str, sampled: DataFrame, centroids: np.ndarray, how: Lists) -> int:
    """How many lists hold the wanted share of a sample's nearest vectors, which exact search finds."""
    probe = sampled.orderBy(F.xxhash64("guid", F.lit(11)), "guid").limit(how.probes).select(F.lit(0).alias("cell"), F.col("guid").alias("query_id"), F.col("embedding").alias("vector"))
    vectors, _ = _stored(spark, folder)
    found = nearest(vectors.select(F.lit(0).alias("cell"), "guid", "embedding"), probe, how.top).select("query_id", "guid")
    placed = vectors.join(found, "guid").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    lists = {r["query_id"]: r["lists"] for r in placed.collect()}  # probes * top numbers
    asked = {r["query_id"]: r["vector"] for r in probe.collect()}
    at = []
    for guid, own in lists.items():
        order = np.argsort(-(_unit(np.array([asked[guid]])) @ centroids.T)[0], kind="stable")
        place = np.empty(len(centroids), np.int64)
        place[order] = np.arange(len(centroids))
        at += [0 if x < 0 else int(place[x]) for x in own]
    return int(np.quantile(at, how.recall, method="higher")) + 1 if at else 1


def index_search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 5, owner=None, language: str | None = None, lists: int | None = None, exact: bool = False) -> DataFrame:
    """``query_id, guid, cosine_distance, rank`` from an index: the nearest lists of each question, compared exactly.

    Only lists with vectors of the owner and language are asked, so a filter takes no results away: of these the nearest
    ``lists`` (None: as many as the index was measured to need), and more until they hold ``k`` vectors.  ``exact`` asks all of them.
    """
    k = min(k, MAX_ROWS)
    centroids = _stored_centroids(spark, folder)
    wanted = [c for c in ((F.col("owner") == owner) if owner is not None else None, (F.col("language") == language) if language is not None else None) if c is not None]
    vectors, sizes = _stored(spark, folder)
    for c in wanted:
        sizes, vectors = sizes.filter(c), vectors.filter(c)
    held = {r["list"]: r["n"] for r in sizes.groupBy("list").agg(F.sum("n").alias("n")).collect()}  # Lists.most rows at most
    lists = lists or spark.read.parquet(f"{folder}/defaults").first()["lists"]
    own = np.array(sorted(x for x in held if x >= 0), np.int64)
    size = np.array([held[x] for x in own.tolist()])
    other = [-1] if -1 in held else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, rows, cells = _lengths(batch.column(1)), [], []
            for i in range(batch.num_rows):
                if d[i] != centroids.shape[1]:
                    cell = np.array(other, np.int64)
                elif exact:
                    cell = own
                else:
                    near = np.argsort(-(centroids[own] @ _unit(np.array([batch.column(1)[i].as_py()]))[0]), kind="stable")
                    enough = int(np.searchsorted(np.cumsum(size[near]), k)) + 1
                    cell = own[near[: max(lists, enough)]]
                rows.append(np.full(len(cell), i))
                cells.append(cell)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(cells) if cells else np.zeros(0, np.int64)).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "query_id", "vector"])

    asked = queries.select("query_id", sound(F.col("vector")).alias("vector")).filter("vector IS NOT NULL")
    kind = queries.schema["query_id"].dataType.simpleString()
    probes = asked.mapInArrow(run, f"cell int, query_id {kind}, vector array<double>")
    return nearest(vectors.select(F.col("list").alias("cell"), "guid", "embedding"), probes, k)


def new_index(chunks: DataFrame, how: Lists = Lists()) -> str:
    """An index in the shared folder."""
    return build_index(chunks, scratch(chunks.sparkSession, "dense-index"), how)
