"""What the operators share: the folder all executors see, staged tables, and vectorised word hashing.

Words are the runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the words' pattern's complement.
SPACES = "[\\x20\\x09-\\x0D]+"

# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine (local masters) one of our own."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = _own_dir()
    return top.rstrip("/") + "/folioscope"


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
    return _OWN[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and survives the loss of any executor."""
    path = new_path(spark, label)
    bounded(spark)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


#: Arrow batches hold texts and sets, so they are bounded by rows and bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20) + "b", str(4 << 20) + "b")}


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where nobody has set them; they stay so, since results are lazy."""
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_writers: dict[int, list] = {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """Within it, an action's shuffle files go when it ends: what it made is in the shared folder. The last of several threads sets the session right again."""
    with _LOCK:
        held = _writers.setdefault(id(spark), [0, spark.conf.get(_CLEAN, None)])
        held[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                _writers.pop(id(spark))
                spark.conf.unset(_CLEAN) if held[1] is None else spark.conf.set(_CLEAN, held[1])


def drop_staged(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Deletes tables made by :func:`staged` that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_folioscope_path", None):
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def carried(df: DataFrame, *extra: Column) -> DataFrame:
    """``df``'s columns as one struct, ``row``, beside ``extra``: whatever they are called, no name of ours meets theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row") if df.columns else F.struct().alias("row"), *extra)


def row_hash(df: DataFrame) -> Column:
    """64 bits of a row's whole content: an order for rows that are equal in all that an operator reads."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() not in ("void", "variant")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit("").cast("binary"))


def word_count(name: str = "text") -> Column:
    """Number of words, JVM-side."""
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    parts = F.split(F.concat(F.lit(" "), text, F.lit(" ")), SPACES)  # an empty string stands at either end
    return F.greatest(F.size(parts) - 2, F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Python workers

#: What a worker keeps from task to task and is large.
KEPT: list[dict] = []


def forget() -> None:
    """Empties what this worker keeps for tasks of another kind."""
    for kept in KEPT:
        kept.clear()


def give_back() -> None:
    """What pyarrow and the C library hold unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function over Arrow batches, as a task that leaves its worker small.

    Workers outlive tasks, and an executor's idle ones count as its busy ones do.  ``keeps``: the task itself reads what workers keep.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


# ---------------------------------------------------------------- vectorised words

_M64 = (1 << 64) - 1
_R = 0x9E3779B97F4A7C13  # r = 3 mod 8, so r - 1 has one factor 2
_R_INV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RAW = np.random.Generator(np.random.PCG64(20250101)).integers(1, 1 << 64, 256, dtype=np.uint64)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, (1 << 19) + 1)
        for k, r in (("p", _R), ("i", _R_INV)):
            a = np.full(m, r, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string column without nulls, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    bufs = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    offsets = np.frombuffer(bufs[1], kind, len(column) + 1, column.offset * width).astype(np.int64) if bufs[1] else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word, and where each row's words begin (one more at the end).

    Bytes count from ``offsets[0]``.  ``lower``: A-Z count as a-z.  ``breaks``: the bytes that stand between words.  Equal words have equal hashes; a prefix sum of
    random byte values times powers of an odd number makes them, so no word becomes a Python object.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    rel = offsets - lo
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = ~breaks[b]
    first = np.zeros(n + 1, bool)
    first[rel] = True  # rows begin here; the last is past the end
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _RAW)[b] * power[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return h, starts, ends, np.searchsorted(starts, rel)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes of one text, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out = out * m + h[j : j + n]
    return mix(out)


def long_windows(h: np.ndarray, k: int) -> np.ndarray:
    """Like :func:`windows`, by prefix sums: the cost doesn't grow with ``k``.  Not the same values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(k)) * power[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])
