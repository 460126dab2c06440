"""Token ids on disk: canonical, length-limited Huffman codes, in blocks that are decoded by table.

Code lengths come from the ids' counts over the whole corpus (package-merge, so no code is longer than ``LIMIT``);
the codes follow from the lengths.  A file holds blocks of ``BLOCK`` ids; each block starts at a byte of its own and has
the bit offset of every ``STEP``-th id, so blocks are independent, and within one all stretches are decoded side by
side, an id of each at a time, by one table look-up.

File: magic; blocks; footer (JSON, zlib); footer's length (8 bytes, little-endian); magic.  The footer has the code
lengths, each block's place and its checkpoints' place, and the documents' ids and counts.

A writer's task makes one file under a name of its own and renames it; a task that runs again replaces it.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_buffers, new_path, partitions, staged
from .tokens import id_type, token_rows

MAGIC = b"FSHUF01\n"
LIMIT, BLOCK, STEP = 18, 1 << 20, 256

# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits for the ids with a count (package-merge, by whole arrays)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) <= 1:
        return lengths
    while 1 << limit < len(used):
        limit += 1
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((leaf, packages))
        at = np.argsort(both, kind="stable")  # leaves stand before packages of the same weight
        levels.append(at < len(leaf))
        ranked = both[at]
        packages = ranked[0 : len(ranked) // 2 * 2 : 2] + ranked[1 : len(ranked) // 2 * 2 : 2]
    take = 2 * len(leaf) - 2
    got = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        got[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ids in order of length, then number, count upwards."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def code_table(lengths: np.ndarray) -> np.ndarray:
    """Each id's code, with its length in the low 5 bits."""
    return (canonical(lengths) << np.uint64(5) | lengths.astype(np.uint64)).astype(np.uint32)


def encode_block(ids: np.ndarray, table: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A block's bits, high bits first, and the bit offset of every STEP-th id."""
    words, points, at = np.zeros(len(ids) * 25 // 32 + 3, np.uint64), [], 0
    for lo in range(0, len(ids), 1 << 15):  # stretches that stay in a processor's cache; 2^15 is a multiple of STEP
        got = table[ids[lo : lo + (1 << 15)]]
        n = (got & np.uint32(31)).astype(np.int32)
        end = np.cumsum(n, dtype=np.int32) + np.int32(at & 31)
        pos = end - n
        word = pos >> 5
        shift = (64 - (pos & 31) - n).astype(np.uint64)
        value = (got >> np.uint32(5)).astype(np.uint64) << shift  # in the 64 bits from the word on; bits don't meet, so sums are unions
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        sums, base = np.add.reduceat(value, heads), at >> 5
        first = word[heads] + base
        words[first] += sums >> np.uint64(32)
        words[first + 1] += sums & np.uint64(0xFFFFFFFF)
        points.append(pos[::STEP].astype(np.int64) + (base << 5))
        at = int(end[-1]) + (base << 5)
    return words[: at // 32 + 1].astype(">u4").tobytes()[: (at + 7) // 8], np.concatenate(points)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each run of ``width`` bits: the id that begins it, and its length in the low 8 bits."""
    width = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    if width > 25:
        raise ValueError("codes of more than 25 bits don't fit the decoder's windows")
    table = np.zeros(1 << width, np.uint32)
    spans = 1 << (width - lengths[order].astype(np.int64))
    filled = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order].astype(np.uint32), spans)
    table[: len(filled)] = filled
    return table, width


def decode_block(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The block's ``n`` ids; all stretches between checkpoints advance together."""
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]  # the 32 bits from each byte on
    at = checkpoints.astype(np.int64)
    out = np.empty((min(STEP, n), len(at)), np.uint32)
    mask, shift, last = (1 << width) - 1, 32 - width, len(ahead) - 1
    for i in range(len(out)):
        got = table[ahead[np.minimum(at >> 3, last)] >> (shift - (at & 7)).astype(np.uint32) & np.uint32(mask)]
        out[i] = got >> np.uint32(8)
        at = at + (got & np.uint32(255))
    return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- files


def write_file(path: str, lengths: np.ndarray, docs: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int, int]:
    """Writes documents, one after another; gives their number, the ids' number and the bytes. Holds one block at a time."""
    fs, name = pafs.FileSystem.from_uri(path)
    codes = code_table(lengths)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    tmp = f"{name}.{uuid.uuid4().hex}.part"
    ids, counts, blocks, waiting, held, total = [], [], [], [], 0, 0
    with fs.open_output_stream(tmp) as out:
        out.write(MAGIC)
        at = len(MAGIC)

        def flush(block: np.ndarray) -> None:
            nonlocal at
            bits, points = encode_block(block, codes)
            marks = zlib.compress(np.diff(points, prepend=0).astype("<u4").tobytes(), 1)
            out.write(bits)
            out.write(marks)
            blocks.append([at, len(bits), len(marks), len(block)])
            at += len(bits) + len(marks)

        for doc_id, tokens in docs:
            ids.append(doc_id)
            counts.append(len(tokens))
            total += len(tokens)
            waiting.append(tokens)
            held += len(tokens)
            if held >= BLOCK:
                run = np.concatenate(waiting)
                whole = len(run) // BLOCK * BLOCK
                for b in range(0, whole, BLOCK):
                    flush(run[b : b + BLOCK])
                waiting, held = [run[whole:]], len(run) - whole
        if held:
            flush(np.concatenate(waiting))
        pack = lambda a, kind: base64.b64encode(zlib.compress(np.asarray(a, kind).tobytes(), 6)).decode()
        nulls = [i for i, x in enumerate(ids) if x is None]
        footer = {"lengths": pack(lengths, "u1"), "blocks": blocks, "doc_ids": pack([0 if x is None else x for x in ids], "<i8"), "null_ids": nulls, "counts": pack(counts, "<i8")}
        body = zlib.compress(json.dumps(footer).encode(), 1)
        out.write(body + struct.pack("<Q", len(body)) + MAGIC)
        at += len(body) + 8 + len(MAGIC)
    fs.move(tmp, name)
    return len(ids), total, at


def read_file(path: str) -> Iterator[tuple[int | None, int, int]]:
    """``doc_id, number of ids, crc32`` of each document of a file; block by block."""
    for doc_id, parts in read_documents(path):
        n = crc = 0
        for ids in parts:
            n += len(ids)
            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
        yield doc_id, n, crc


def read_documents(path: str) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """Each document's id and the stretches of its ids; take the stretches before the next document."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} has no footer")
        n = struct.unpack("<Q", tail[:8])[0]
        footer = json.loads(zlib.decompress(f.read_at(n, size - 8 - len(MAGIC) - n)))
        unpack = lambda x, kind: np.frombuffer(zlib.decompress(base64.b64decode(x)), kind)
        table, width = decode_table(unpack(footer["lengths"], "u1"))
        nulls = set(footer["null_ids"])

        def decoded() -> Iterator[np.ndarray]:
            for at, bits, marks, count in footer["blocks"]:
                raw = f.read_at(bits + marks, at)
                points = np.cumsum(np.frombuffer(zlib.decompress(raw[bits:]), "<u4").astype(np.int64))
                yield decode_block(raw[:bits], points, count, table, width)

        stream, left = decoded(), np.zeros(0, np.uint32)

        def take(n: int) -> Iterator[np.ndarray]:
            nonlocal left
            while n:
                if not len(left):
                    left = next(stream)
                part, left = left[:n], left[n:]
                n -= len(part)
                yield part

        for i, (doc_id, count) in enumerate(zip(unpack(footer["doc_ids"], "<i8").tolist(), unpack(footer["counts"], "<i8").tolist(), strict=True)):
            yield (None if i in nulls else doc_id), take(count)


# ---------------------------------------------------------------- Spark


def id_counts(rows: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs in all rows: tasks count, and an aggregation adds up; at most ``size`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = binary_buffers(batch.column(0))
            total += np.bincount(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """Writes all documents' ids in ascending order of document id; gives the manifest ``part, path, docs, ids, bytes``.

    Null ids come first; rows that share an id are ordered by their ids' bytes.  A null text is the end id alone.
    """
    from .tokens import encoder

    dtype, size = id_type(tokenizer), max(encoder(tokenizer).size, end_id + 1)
    rows = staged(spark, token_rows(docs, tokenizer, end_id, id_column).select("doc_id", "ids"), "ids")
    lengths = spark.sparkContext.broadcast(code_lengths(id_counts(rows, size, dtype)))  # a byte for each id of the vocabulary
    folder = folder or new_path(spark, "huffman")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.fsh"
        first = next(((b) for b in batches if b.num_rows), None)
        if first is None:
            return

        def documents():
            for b in _chain(first, batches):
                for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc_id, np.frombuffer(ids, dtype)

        n, total, size = write_file(path, lengths.value, documents())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (n, total, size))], names=["part", "path", "docs", "ids", "bytes"])

    order = rows.repartitionByRange(max(partitions(spark), 1), "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    return staged(spark, order.mapInArrow(write, "part long, path string, docs long, ids long, bytes long"), "manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, read by one task for each file."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).select("path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], base
                for doc_id, n, crc in read_file(path):
                    rows.append((doc_id, at, n, crc))
                    at += n
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.repartition(max(partitions(spark), 1), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])
