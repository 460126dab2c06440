"""Pages to chunks: a page within the budget is one chunk, a longer one is packed by blocks, which are never split."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

BUDGET = 500


def whitespace_tokens(text: Column) -> Column:
    """The offline token count."""
    return F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))


def bpe_tokens(path: str):
    """A count of tokens by a public tokenizer's file, over texts: for :func:`counted_chunks`, which counts before it packs."""

    def count(texts: Column) -> Column:
        @F.arrow_udf("array<int>")
        def each(batch: pa.Array) -> pa.Array:
            tokenizer = _tokenizer(path)
            sizes = pa.array([len(e.ids) for e in tokenizer.encode_batch(["" if t is None else t for t in batch.flatten().to_pylist()], add_special_tokens=False)], pa.int32())
            start = batch.offsets[0].as_py()
            return pa.ListArray.from_arrays(pa.array([o - start for o in batch.offsets.to_pylist()], pa.int32()), sizes)

        return each(texts)

    return count


@functools.cache
def _tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def counted_chunks(pages: DataFrame, budget: int, count) -> DataFrame:
    """Adds ``chunks``, as :func:`chunks_of` cuts them, with tokens counted by an Arrow function: the page's text and its blocks go there once."""
    blocks = F.filter(F.coalesce("blocks", F.array().cast("array<string>")), lambda b: b != "")
    sized = pages.withColumn("_blocks", blocks).withColumn("_sizes", count(F.concat(F.array(F.coalesce("text", F.lit(""))), F.col("_blocks"))))
    pairs = F.zip_with("_blocks", F.slice("_sizes", F.lit(2), F.size("_blocks")), lambda b, n: F.struct(b.alias("b"), n.alias("n")))
    packed = _packed(pairs, budget, lambda x: x["b"], lambda x: x["n"])
    return sized.withColumn("chunks", F.when(F.col("_sizes")[0] <= budget, F.array("text")).when(F.size(packed) > 0, packed).otherwise(F.array("text"))).drop("_blocks", "_sizes")


def pack_blocks(blocks: Column, budget: int = BUDGET, tokens=whitespace_tokens) -> Column:
    """``array<string>`` in reading order to ``array<string>``: blocks joined by line breaks, filled greedily.

    A block that doesn't fit begins the next chunk; one that is over the budget alone stays whole; empty ones are left out.
    """
    return _packed(F.filter(blocks, lambda b: b != ""), budget, lambda b: b, tokens)


def _packed(items: Column, budget: int, text, size) -> Column:
    """Greedy packing of items with a text and a size."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def step(s: Column, item: Column) -> Column:
        t, b = size(item), text(item)
        full = (F.size(s["open"]) > 0) & (s["n"] + t > budget)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(b)).otherwise(F.concat(s["open"], F.array(b))).alias("open"),
            F.when(full, t).otherwise(s["n"] + t).alias("n"),
        )

    def finish(s: Column) -> Column:
        return F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"])

    return F.aggregate(items, start, step, finish)


def chunks_of(text: Column, blocks: Column, budget: int = BUDGET, tokens=whitespace_tokens, strict: bool = False) -> Column:
    """The chunks of a page. ``strict``: a page over the budget without blocks gives one empty chunk; else it stays whole."""
    packed = pack_blocks(blocks, budget, tokens)
    empty = F.array(F.lit("")) if strict else F.array(text)
    return F.when(tokens(text) <= budget, F.array(text)).when(F.size(packed) > 0, packed).otherwise(empty)


def chunk_rows(pages: DataFrame, budget: int = BUDGET, tokens=whitespace_tokens, count=None) -> DataFrame:
    """``guid, owner, source_key, language, page_number, text, blocks`` to a row for each chunk, with ids that follow from the page's. Blank pages have none.

    ``count``: an Arrow function that counts tokens, as :func:`bpe_tokens` gives it, in place of the expression ``tokens``.
    """
    own = pages.filter(F.col("text").rlike("(?U)\\S"))
    own = counted_chunks(own, budget, count) if count else own.withColumn("chunks", chunks_of(F.col("text"), F.col("blocks"), budget, tokens))
    each = own.select("guid", "owner", "source_key", "language", "page_number", F.posexplode("chunks").alias("ord", "chunk_text"))
    return each.select(ids.chunk_id(F.col("guid"), F.col("ord")).alias("guid"), "owner", F.col("guid").alias("parent"), "ord", "source_key", "language", "page_number", F.col("chunk_text").alias("text"))


def replace_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored chunks of other pages, and the new ones: all of a page's chunks are replaced together."""
    return stored.join(new.select("parent").distinct(), "parent", "left_anti").unionByName(new)


def chunk_embed_replace(pages: DataFrame, stored: DataFrame, embedder, budget: int = BUDGET, tokens=whitespace_tokens) -> DataFrame:
    """The stored chunks after the given pages were chunked and embedded anew. Ids follow from the pages', so doing it twice changes nothing."""
    from ..plans.providers import embed_column

    return replace_chunks(stored, embed_column(chunk_rows(pages, budget, tokens), embedder).select(*stored.columns))
