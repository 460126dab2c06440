"""Page documents as nested tables, and what is stored about them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

BOX = "struct<x: double, y: double, w: double, h: double>"
WORD = f"struct<id: string, text: string, bbox: {BOX}, lang: string, style: string, char_start: int, char_end: int, bbox_source: string>"
BLOCK = (
    f"struct<id: string, local_id: string, type: string, reading_order: int, bbox: {BOX}, text: string, words: array<{WORD}>, sutra_ref: string, footnote_marker: string, section_path: array<string>, "
    "continues_from_previous_page: boolean, continues_on_next_page: boolean, parent_block_id: string, layout: struct<font_pt: double, scale: double, fits: boolean>>"
)
PAGE = f"schema_version int, page int, printed_page_number string, image string, lang string, source_key string, model string, blocks array<{BLOCK}>"


#: Where page documents are: one file each, ``<language>/<source key>/json/page_*.json``; or one folder each, as :func:`write_page_json` makes them.
FILES, FOLDERS = "*/*/json/page_*.json", "language=*/source_key=*/page=*"


def there(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or any of a pattern's, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """``language, source_key, path, stamp`` of all page documents, from listings alone: ``stamp`` changes with a file's size and time."""
    found = None
    for pattern, names in ((FILES, "([^/]+)/([^/]+)/json/[^/]+$"), (FOLDERS, "language=([^/]+)/source_key=([^/]+)/page=[^/]+/[^/]+$")):
        if there(spark, f"{folder}/{pattern}"):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/{pattern}")
            part = lambda k, names=names: F.url_decode(F.regexp_extract("path", names, k))
            rows = files.select(part(1).alias("language"), part(2).alias("source_key"), "path", F.xxhash64("path", "length", F.col("modificationTime").cast("double")).alias("stamp"))
            found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], "language string, source_key string, path string, stamp long") if found is None else found


def source_stamps(files: DataFrame) -> DataFrame:
    """``language, source_key, files, stamp`` of each source, whatever the order of its files."""
    return files.groupBy("language", "source_key").agg(F.count(F.lit(1)).alias("files"), F.expr("bit_xor(stamp)").alias("stamp"))


def read_page_json(spark: SparkSession, folder: str, only: list[tuple[str, str]] | None = None) -> DataFrame:
    """Page documents of both layouts; the path says language and source. ``only``: (language, source key) of the sources to read."""
    schema = PAGE.replace(" source_key string,", "") + ", language string, source_key string"
    names = [f.split(":")[0] for f in spark.createDataFrame([], schema).schema.names]
    found = spark.createDataFrame([], schema)
    sources = [("*", "*")] if only is None else only
    paths = [p for x, y in sources if there(spark, p := f"{folder}/{x}/{y}/json/page_*.json")]
    if paths:
        raw = spark.read.schema(PAGE).json(paths, multiLine=True)
        part = lambda k: F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/([^/]+)/json/[^/]+$", k))
        found = raw.withColumn("language", part(1)).withColumn("source_key", part(2)).select(*names)
    made = [p for x, y in sources if there(spark, p := f"{folder}/language={x}/source_key={y}")]
    if made:
        found = found.unionByName(spark.read.schema(schema).option("basePath", folder).json(made).select(*names))
    return found


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows to store: ids from source, language and page; the page's text is its blocks' texts, empty ones left out; digests of blocks and of the page."""
    text = F.array_join(F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    owner = ids.source_id(F.col("source_key"), F.col("language"))
    blocks = F.transform(F.array_sort("blocks", lambda a, b: F.when(a["reading_order"] < b["reading_order"], -1).when(a["reading_order"] > b["reading_order"], 1).otherwise(0)), lambda b: b["text"])
    rows = pages.select(ids.page_id(F.col("source_key"), F.col("language"), F.col("page")).alias("guid"), owner.alias("owner"), "source_key", "language", F.col("page").alias("page_number"), text.alias("text"), blocks.alias("blocks"))
    return rows.withColumn("block_digests", F.transform("blocks", lambda b: F.md5(F.coalesce(b, F.lit(""))))).withColumn("digest", F.md5(F.concat_ws(" ", F.md5(F.coalesce("text", F.lit(""))), "block_digests")))


def source_rows(pages: DataFrame) -> DataFrame:
    """A row for each source with a page at least."""
    g = pages.groupBy("source_key", "language").agg(F.count(F.lit(1)).alias("recognised_pages"), F.min("page").alias("first_page"))
    guid = ids.source_id(F.col("source_key"), F.col("language"))
    return g.select(guid.alias("guid"), guid.alias("owner"), "source_key", "language", F.replace("source_key", F.lit("_"), F.lit(" ")).alias("title"), "recognised_pages", "first_page")


def write_page_json(pages: DataFrame, folder: str) -> None:
    """A folder for each page, ``language=.../source_key=.../page=...``: pages that are written again take their folders' place, others stay."""
    names = [n for n in pages.sparkSession.createDataFrame([], PAGE).schema.names if n in pages.columns and n not in ("page", "source_key")]
    out = pages.select(*names, "language", "source_key", F.col("page").cast("int").alias("page"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language", "source_key", "page").json(folder)


def swap_snapshot(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Writes a new snapshot beside the old ones and then a pointer to it. Pointers are numbered and never changed, so readers see one snapshot or the next, whole."""
    version = uuid.uuid4().hex
    path = f"{folder}/snapshot={version}"
    df.write.parquet(path)
    last = _pointers(spark, folder).agg(F.max("number")).first()[0] or 0
    spark.createDataFrame([(last + 1, version)], "number long, version string").coalesce(1).write.mode("append").json(f"{folder}/pointers")
    return path


def _pointers(spark: SparkSession, folder: str) -> DataFrame:
    schema = "number long, version string"
    try:
        return spark.read.schema(schema).json(f"{folder}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot with the greatest number (of two written at once, by version); LookupError before the first."""
    found = _pointers(spark, folder).orderBy(F.desc("number"), F.desc("version")).first()
    if found is None:
        raise LookupError(f"no snapshot in {folder}")
    return spark.read.parquet(f"{folder}/snapshot={found['version']}")


def complete_sources(pages: DataFrame, indexes: DataFrame) -> DataFrame:
    """Pages of sources that have an index (``source_key, language``) and a page at least."""
    return pages.join(indexes.select("source_key", "language").distinct(), ["source_key", "language"], "left_semi")


def scan_files(spark: SparkSession, folder: str, suffix: str = ".pdf", known: DataFrame | None = None) -> DataFrame:
    """``path, name, length, modified, content`` of files; those whose ``name`` is in ``known`` are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")
    return rows if known is None else rows.join(known.select("name"), "name", "left_anti")


def cached_readings(files: DataFrame, cache: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """``path, length, reading``: files known by path and length come from the cache, others are read. Store the result as the next cache."""
    old = files.select("path", "length").join(cache, ["path", "length"])
    missing = files.join(cache.select("path", "length"), ["path", "length"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "length": f.length, "reading": [read(bytes(c)).replace("\0", "") for c in f.content]})

    return old.unionByName(missing.select("path", "length", "content").mapInPandas(run, "path string, length long, reading string"))


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """``source_key, language, page, content`` of files ``<language>/<source key>/page_<number>.*``."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/*/page_*")
    part = lambda k: F.url_decode(F.regexp_extract("path", "([^/]+)/([^/]+)/page_0*([0-9]+)[^/]*$", k))
    return files.select(part(2).alias("source_key"), part(1).alias("language"), part(3).cast("int").alias("page"), "content")


def pages_to_do(spark: SparkSession, start: int, end: int, done: DataFrame, force: bool = False) -> DataFrame:
    """Pages from ``start`` to ``end`` that aren't done yet; all if forced."""
    wanted = spark.range(start, end + 1).select(F.col("id").cast("int").alias("page"))
    return wanted if force else wanted.join(done.select("page"), "page", "left_anti")


def html_headings(pages: DataFrame) -> DataFrame:
    """``page_id, idx, level, title`` of the headings h1 to h6, in order."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))).alias("idx", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace("h", "(?s)<[^>]*>", " "), "\\s+", " "))
    return each.select("page_id", "idx", F.regexp_extract("h", "(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))
