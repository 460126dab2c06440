"""Tables kept in buckets of their key: a change writes the buckets it touches, and every snapshot shares the rest.

A folder has ``files/<version>/bucket=<n>`` and a manifest for each snapshot, ``manifests/<number>``, which says for every
bucket the version whose files hold it.  Files and manifests are never changed.  A manifest is made by exclusive creation, so
of two writers that began with one snapshot the second fails and begins again; readers see one snapshot or the next, whole.

Defined cases: of several rows with one key the last by the order given, then by content, holds; a change without rows and
keys makes no snapshot; a null key is a key; a bucket that has lost all its rows has no files.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sync import _one_per_key
from ..plans.session import written

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made a snapshot meanwhile."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The snapshots that are there, oldest first."""
    fs, at = _fs(spark, f"{folder}/manifests")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def manifest(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifests/{number}", wholetext=True).first()[0])


def _commit(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    fs, at = _fs(spark, f"{folder}/manifests/{number}")
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        raise Conflict(f"snapshot {number} of {folder} was made meanwhile") from e
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def current(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The newest snapshot, or one by its number; LookupError before the first."""
    known = numbers(spark, folder)
    if not known:
        raise LookupError(f"no snapshot in {folder}")
    return _rows(spark, folder, manifest(spark, folder, known[-1] if number is None else number))


def _rows(spark: SparkSession, folder: str, m: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(m["schema"])
    paths = [f"{folder}/files/{v}/bucket={b}" for b, v in m["buckets"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def merge(spark: SparkSession, folder: str, rows: DataFrame | None = None, gone: DataFrame | None = None, key: str = "guid", order: tuple[str, ...] = (), buckets: int = BUCKETS) -> int | None:
    """Makes a snapshot with ``rows`` in place of those of their keys, or added, and without the keys of ``gone``; gives its number, or None where there was nothing to do.

    Reads and writes the buckets of these keys alone.  A key in both stays, as in ``rows``.
    """
    known = numbers(spark, folder)
    m = manifest(spark, folder, known[-1]) if known else None
    if m is None and rows is None:
        return None
    n = m["n"] if m else buckets
    schema = StructType.fromJson(m["schema"]) if m else rows.schema
    new = written(_one_per_key(rows.select(*schema.names), key, *order), "rows") if rows is not None else None
    lost = written(gone.select(key).distinct(), "gone") if gone is not None else None
    changed = [df.select(F.col(key)) for df in (new, lost) if df is not None]
    keys = changed[0].unionByName(changed[1]) if len(changed) == 2 else changed[0] if changed else None
    touched = {r[0] for r in keys.select(_bucket(key, n)).distinct().collect()} if keys is not None else set()  # n rows at most
    if not touched and m:
        return None
    kept = _rows(spark, folder, m, touched) if m else spark.createDataFrame([], schema)
    kept = kept.join(keys.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti") if keys is not None else kept
    out = kept.unionByName(new) if new is not None else kept
    version = uuid.uuid4().hex
    path = f"{folder}/files/{version}"
    out.withColumn("bucket", _bucket(key, n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    fs, at = _fs(spark, path)
    made = {int(name.removeprefix("bucket=")) for f in fs.listStatus(at) if (name := f.getPath().getName()).startswith("bucket=")}
    held = {b: v for b, v in (m["buckets"] if m else {}).items() if int(b) not in touched} | {str(b): version for b in sorted(made)}
    number = known[-1] + 1 if known else 1
    _commit(spark, folder, number, {"n": n, "key": key, "schema": schema.jsonValue(), "buckets": held})
    return number


def expire(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes the files that none of the last ``keep`` snapshots holds, and the older manifests; gives the number of folders deleted.

    Run it while nobody writes: files of a snapshot that is being made are no snapshot's yet.
    """
    known = numbers(spark, folder)
    held = {f"{v}/bucket={b}" for number in known[-keep:] for b, v in manifest(spark, folder, number)["buckets"].items()}
    fs, at = _fs(spark, f"{folder}/files")
    done = 0
    for version in fs.listStatus(at) if fs.exists(at) else []:
        own = [f.getPath() for f in fs.listStatus(version.getPath()) if f.getPath().getName().startswith("bucket=")]
        old = [p for p in own if f"{version.getPath().getName()}/{p.getName()}" not in held]
        for p in old:
            fs.delete(p, True)
        if len(old) == len(own):
            fs.delete(version.getPath(), True)
        done += len(old)
    for number in known[:-keep]:
        fs.delete(_fs(spark, f"{folder}/manifests/{number}")[1], False)
    return done
