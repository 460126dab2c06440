"""New page documents as a stream: chunks are made as files arrive, and a batch that runs again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_rows
from ..plans.session import written
from ..sources.pages import PAGE, page_rows
from ..sources.snapshots import current, merge


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Page documents, one JSON line each, in a folder for each page (``language=.../source_key=.../page=...``) as files appear."""
    schema = PAGE.replace(", source_key string", "") + ", language string, source_key string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest(spark: SparkSession, folder: str, chunks: str, checkpoint: str, budget: int = 500) -> StreamingQuery:
    """Merges each batch's chunks into a table of snapshots, in place of all that their pages had before.

    Ids follow from the pages', so neither a batch that runs again nor a page that comes again in a later one gives a chunk twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        pages = written(page_rows(batch).dropDuplicates(["guid"]), "pages")
        new = written(chunk_rows(pages, budget), "chunks")
        try:
            gone = current(spark, chunks).join(pages.select(F.col("guid").alias("parent")), "parent").select("guid")
        except LookupError:
            gone = None
        merge(spark, chunks, new, gone)

    return page_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
