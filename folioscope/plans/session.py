"""A session with what the operators count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "folioscope", master: str | None = None, **conf: object) -> SparkSession:
    """Adaptive execution, UTC, Arrow. Sizes of partitions and memory are left to the cluster; ``conf`` adds to it."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table, where driver and executors both reach it: under spark.checkpoint.dir, or on a local master without one in a folder of its own."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="folioscope-core-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        top = f"file://{_LOCAL[0]}"
    return f"{top.rstrip('/')}/folioscope-core/{label}-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: for what several branches of a plan read, and to cut lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
