"""Packing token streams into sequences: concatenate and cut.

All documents' ids stand one after another; every ``length`` ids are a sequence, so only the last one can be short.
Two passes: the first writes each task's ids with their offsets within the task; the tasks' totals, summed up, give
each task its place in the whole; the second cuts every document at the sequences' bounds and returns the pieces.

Defined cases: a null or empty text is the end id alone; equal rows and repeated ids are packed as often as they occur;
a null id stays null; a long text is cut as often as needed; an empty table has no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, tidied
from .tokens import id_type, token_rows

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def part_bases(rows: DataFrame) -> DataFrame:
    """``part, base``: the ids before each part. One row for each task of the first pass, so its size is bounded by their number."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of the packed sequences; ``with_ids``: with each piece's ids, as bytes.

    ``tokenizer``: the path of a public tokenizer's file on every machine.
    """
    rows = staged(spark, token_rows(docs, tokenizer, end_id, id_column), "tokens")
    placed = rows.join(F.broadcast(part_bases(rows)), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "ids")
    dtype = id_type(tokenizer)
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, cols = [], [[] for _ in range(6)]
            kept = []
            for i, (at, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                wide = np.frombuffer(ids, dtype).astype("<u4")
                n, s = len(wide), 0
                while s < n:
                    seq, off = divmod(at + s, length)
                    e = min(n, s + length - off)
                    piece = wide[s:e].tobytes()
                    which.append(i)
                    for col, v in zip(cols, (s, e - s, zlib.crc32(piece), n, seq, off), strict=True):
                        col.append(v)
                    if with_ids:
                        kept.append(piece)
                    s = e
            arrays = [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return placed.mapInArrow(tidied(cut), schema)
